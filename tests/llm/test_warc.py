import gzip
import hashlib
import zlib

import pytest

from graphspark.llm import warc


def pages():
    big, other = "<html>" + "x" * 2000, "<html>" + "é" * 700
    table = [(i, f"http://h/{i}", big) for i in range(40)] + [(100, "http://h/a b", other), (101, None, other), (102, "u", "short"), (103, "u", "short"), (104, "u", None), (105, "u", ""), (106, "u", "y" * 999), (107, "u", "y" * 999), (108, "u", "\r\n\r\nWARC/1.1\r\n"), (109, "u", "z" * 100_000)]
    return table


def test_whole_query(spark):
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages()], "page_id long, url string, html string, digest string, salt int").repartition(3)
    out = {r.page_id: r for r in warc.archive_and_read(df).collect()}
    assert len(out) == len(pages())
    for i, _, html in pages():
        data = (html or "").encode()
        same = [j for j, _, h in pages() if (h or "").encode() == data]
        to = max(same) if len(data) >= 1000 and max(same) != i else None
        r = out[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to)


def test_archives_are_gzip_of_one_record_a_member(spark):
    chunks = warc.archive_pages(spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1)).collect()
    data = b"".join(bytes(c.bytes) for c in chunks)
    assert sum(c.n_records for c in chunks) == len(pages()) == len(list(warc.members([data])))
    assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == len(pages())
    # pieces of any size give the same records
    whole = list(warc.read_records([data]))
    assert whole == list(warc.read_records([data[i : i + 7] for i in range(0, len(data), 7)]))


def test_broken_archives_are_refused():
    one = warc.page_record(1, "http://a", b"payload", None)
    fields, block = next(warc.read_records([one]))
    assert warc.payload_of(fields, block) == (7, hashlib.sha1(b"payload").hexdigest())
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records([one[:-9]]))
    plain = zlib.decompress(one, 31)
    pack = lambda b: gzip.compress(b)
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records([pack(plain.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"))]))
    with pytest.raises(ValueError, match="frame"):
        list(warc.read_records([pack(plain[:-4])]))
    with pytest.raises(ValueError, match="payload digest"):
        warc.payload_of({**fields, "warc-payload-digest": warc.sha1_label(b"other")}, block)


def test_files_and_odd_tables(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(warc.page_record(7, "http://a", b"p" * 1500, None) + warc.page_record(3, "http://b", b"p" * 1500, 7))
    assert sorted((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in warc.read_warc_files(spark, str(tmp_path)).collect()) == [(3, "revisit", 1500, 7), (7, "response", 1500, None)]
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    odd = spark.createDataFrame([(None, None, "q" * 1200), (4, None, "q" * 1200), (4, None, "q" * 1200), (None, None, None)], "page_id long, url string, html string")
    assert sorted([(r.page_id, r.record_type, r.refers_to) for r in warc.archive_and_read(odd).collect()], key=str) == sorted([(None, "revisit", 4), (4, "response", None), (4, "response", None), (None, "response", None)], key=str)
