"""WARC archives: writing and sequential reading.

Each record is a gzip member of its own. The reader goes through an archive from
front to back: incremental zlib decompression finds where each member ends,
Content-Length frames the block, and block and payload digests are verified.

Archives are kept as ordered chunks of bytes (archive, chunk, bytes) in a table
that Spark writes, so they can live in any store that Spark reaches; several
records share a chunk and no record is split. ``read_warc_files`` reads .warc.gz
files through Spark's binaryFile source.

Defined results: null html is the empty payload; repeated ids each get a record;
records of equal payloads of at least ``revisit_from`` bytes revisit the one with
the largest id (rows that repeat that id are all responses); a record is built and
read as a whole, so a payload of any length costs a few times its length in memory;
an empty table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.llm._batches import slices, utf8, values
from graphspark.llm._salting import join_groups
from graphspark.session import ensure_importable, materialize

CHUNK = 4 << 20
#: Copies of one payload that one key holds: a larger group is dealt over several.
PAGES_PER_KEY = 2_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def write_record(fields: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"WARC-Block-Digest: {sha1_label(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or, with ``refers_to``, a revisit that keeps the HTTP header only."""
    clean = "".join(c for c in url if c > " ") or "urn:none"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(f"page:{page_id}")), ("WARC-Date", DATE), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", sha1_label(payload)), ("X-Page-Id", "" if page_id is None else str(page_id)), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(f"page:{refers_to}")), ("X-Refers-To-Page-Id", str(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return write_record(fields, http + (payload if refers_to is None else b""))


def members(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream that comes in pieces, each decompressed."""
    z, out = zlib.decompressobj(31), []
    for piece in pieces:
        while piece:
            out.append(z.decompress(piece))
            piece = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the archive ends inside a member")


def read_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with names in lower case, block) of each record, in order. Raises ValueError on a broken frame or digest."""
    for data in members(pieces):
        head, mark, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not mark or not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        block = rest[:n]
        if len(block) != n or rest[n:] != b"\r\n\r\n":
            raise ValueError(f"bad frame of {fields.get('warc-record-id')}")
        if "warc-block-digest" in fields and fields["warc-block-digest"] != sha1_label(block):
            raise ValueError(f"bad block digest of {fields.get('warc-record-id')}")
        yield fields, block


def payload_of(fields: dict[str, str], block: bytes) -> tuple[int, str]:
    """(length, hexadecimal SHA-1) of the full payload; a response's digest is verified against its bytes."""
    http, _, body = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].split(":", 1)[1]).hex()
    if fields["warc-type"] == "response":
        if hashlib.sha1(body).hexdigest() != digest:
            raise ValueError(f"bad payload digest of {fields.get('warc-record-id')}")
        return len(body), digest
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return length, digest


_ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string"
_ROWS_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("archive", pa.string())])


def _rows(pieces: Iterable[bytes], archive: str) -> Iterator[pa.RecordBatch]:
    rows = []
    for fields, block in read_records(pieces):
        n, digest = payload_of(fields, block)
        own, to = fields.get("x-page-id") or None, fields.get("x-refers-to-page-id")
        rows.append((own and int(own), n, digest, fields["warc-type"], to and int(to), fields.get("warc-target-uri"), archive))
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ROWS_ARROW, strict=True)], schema=_ROWS_ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ROWS_ARROW, strict=True)], schema=_ROWS_ARROW)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 1000) -> DataFrame:
    """Chunks of archives: archive, chunk, n_records, bytes. One archive per partition."""
    ensure_importable(pages.sparkSession)
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= revisit_from, F.sha1(F.col("html").cast("binary")))
    # Only digests that occur more than once are joined to; a page that is alone or short has a key of its own, and the
    # pages of one digest are dealt over keys by their number, so that neither nulls nor a large group of copies meet in one task.
    groups = page.select("page_id", digest.alias("digest")).where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    keyed = page.select("page_id", "url", "html", F.coalesce(digest, F.concat(F.lit("-"), F.hex(F.xxhash64("page_id", "url")))).alias("digest"))
    linked = join_groups(keyed, materialize(groups, "copies"), "digest", PAGES_PER_KEY, "left")

    def written(batches):
        task, chunk, held, size = TaskContext.get().partitionId(), 0, [], 0
        schema = pa.schema([("archive", pa.string()), ("chunk", pa.int32()), ("n_records", pa.int32()), ("bytes", pa.binary())])

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}.warc.gz"]), pa.array([chunk], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([b"".join(held)], pa.binary())], schema=schema)

        for batch in slices(batches, "html"):
            for page_id, url, payload, to in zip(values(batch, "page_id"), values(batch, "url"), utf8(batch, "html"), values(batch, "refers_to"), strict=True):
                held.append(page_record(page_id, url or "", payload, None if to is None or to == page_id else to))
                size += len(held[-1])
                if size >= CHUNK:
                    yield flush()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield flush()

    return linked.select("page_id", "url", "html", "refers_to").mapInArrow(written, "archive string, chunk int, n_records int, bytes binary")


def read_archives(chunks: DataFrame) -> DataFrame:
    """The records of archives kept as chunks; a chunk holds whole records, so chunks are read in parallel, each from front to back."""
    ensure_importable(chunks.sparkSession)

    def read(batches):
        for batch in batches:
            for archive, data in zip(values(batch, "archive"), values(batch, "bytes"), strict=True):
                yield from _rows([data[i : i + 65536] for i in range(0, len(data), 65536)], archive)

    return chunks.select("archive", "bytes").mapInArrow(read, _ROWS)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc.gz files (one archive per file)."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("bytes")))


def archive_and_read(pages: DataFrame, **columns) -> DataFrame:
    """Write the archives to the shared folder, then read them back."""
    return read_archives(materialize(archive_pages(pages, **columns), "warc"))
