import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from graphspark.llm import media
from tests.llm.fixtures import docs, nothing, rows, text_of

RGB = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
GREY = RGB[:, :, :1]


def brute_resize(image, height, width):
    """Every sample cut into height x width parts, so that each cell is a plain mean."""
    h, w, _ = image.shape
    fine = np.repeat(np.repeat(image.astype(float), height, axis=0), width, axis=1)
    return fine.reshape(height, h, width, w, -1).mean(axis=(1, 3))


@pytest.mark.parametrize("shape", [(1, 1), (3, 4), (8, 9), (16, 16), (5, 7)])
def test_area_resize(shape, monkeypatch):
    want = brute_resize(RGB, *shape)
    assert np.allclose(media.area_resize(RGB, *shape), want)
    monkeypatch.setattr(media, "STRIPE", 30)  # several stripes
    assert np.allclose(media.area_resize(RGB, *shape), want)


def samples(data):
    return media.decode_image(data)[0]


def test_netpbm():
    body = " ".join(map(str, GREY.reshape(-1)))
    assert (samples(b"P5 # a comment\n7 5\n255\n" + GREY.tobytes()) == GREY).all()
    assert (samples(b"P6\n7 5 255\n" + RGB.tobytes()) == RGB).all()
    assert (samples(f"P2\n7 5\n255\n{body}".encode()) == GREY).all()
    assert (samples(("P3\n7 5\n255\n" + " ".join(map(str, RGB.reshape(-1)))).encode()) == RGB).all()
    assert samples(b"P1\n3 2\n101\n0 1 0")[:, :, 0].tolist() == [[0, 1, 0], [1, 0, 1]]
    assert samples(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000]))[:, :, 0].tolist() == [[0, 1, 0], [1, 0, 1]]
    assert (samples(b"P7\nWIDTH 7\nHEIGHT 5\nDEPTH 3\nMAXVAL 255\nTUPLTYPE RGB\nENDHDR\n" + RGB.tobytes()) == RGB).all()
    wide = GREY.astype(np.uint16) * 257
    assert (samples(b"P5\n7 5\n65535\n" + wide.astype(">u2").tobytes()) == wide).all()


@pytest.mark.parametrize(("head", "body", "want"), [(b"P5\n1 1\n15\n", b"\x0f", 255), (b"P5\n1 1\n15\n", b"\x03", 51), (b"P5\n1 1\n65535\n", b"\x01\x01", 1), (b"P5\n1 1\n255\n", b"\x01", 1), (b"P4\n1 1\n", b"\x00", 255)])
def test_white_is_the_files_maximal_value(head, body, want):
    image, top = media.decode_image(head + body)
    assert np.load(io.BytesIO(media.npy_tile(image, 1, top))).reshape(-1).tolist() == [want]


def bmp(bits, body, w, h, packed=0, extra=b""):
    return b"BM" + struct.pack("<IHHI", 54 + len(extra) + len(body), 0, 0, 54 + len(extra)) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, packed, len(body), 0, 0, 2 if bits == 1 else 0, 0) + extra + body


def test_bmp():
    assert (samples(media.encode_bmp(RGB)) == RGB).all()  # 24 bits, bottom-up, padded rows
    palette = bytes([0, 0, 255, 0, 0, 255, 0, 0])  # red, green
    image = samples(bmp(1, bytes([0b01000000, 0, 0, 0, 0b10100000, 0, 0, 0]), 3, -2, extra=palette))
    assert image[0].tolist() == [[255, 0, 0], [0, 255, 0], [255, 0, 0]] and image[1].tolist() == [[0, 255, 0], [255, 0, 0], [0, 255, 0]]
    greys = b"".join(bytes([i * 17] * 3 + [0]) for i in range(16))
    assert samples(bmp(4, bytes([0x1F, 0x30, 0, 0, 0x02, 0x40, 0, 0]), 3, 2, extra=greys))[:, :, 0].tolist() == [[0, 34, 68], [17, 255, 51]]
    assert samples(bmp(32, bytes([1, 2, 3, 9, 4, 5, 6, 9]), 2, 1))[0].tolist() == [[3, 2, 1], [6, 5, 4]]
    masks = struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)  # red first
    assert samples(bmp(32, bytes([1, 2, 3, 9]), 1, 1, 3, masks))[0].tolist() == [[1, 2, 3]]
    assert samples(bmp(16, struct.pack("<HH", 0x7C00, 0x03FF), 2, 1))[0].tolist() == [[255, 0, 0], [0, 255, 255]]
    assert samples(bmp(16, struct.pack("<HH", 0xF800, 0x07E0), 2, 1, 3, struct.pack("<III", 0xF800, 0x7E0, 0x1F)))[0].tolist() == [[255, 0, 0], [0, 255, 0]]
    for bad in (bmp(8, b"", 1, 1, 1), bmp(24, b"", 5, 5), bmp(2, bytes(4), 1, 1)):
        with pytest.raises(ValueError):
            media.decode_image(bad)


def test_difference_hash_and_tile():
    ramp = np.tile(np.arange(90, dtype=np.uint8), (16, 1))[:, :, None]
    assert media.difference_hash(ramp) == "f" * 16 and media.difference_hash(ramp[:, ::-1]) == "0" * 16
    tile = np.load(io.BytesIO(media.npy_tile(ramp, 4)))
    assert tile.shape == (4, 4, 1) and (np.diff(tile[0, :, 0].astype(int)) > 0).all()


def test_features_table(spark):
    good = media.encode_pgm(GREY[:, :, 0])
    df = spark.createDataFrame([(1, good), (2, good), (3, None), (4, b"P5\n9 9\n255\nxx"), (5, b"BM"), (6, b"")], "id long, image binary")
    out = {r.id: r for r in media.image_features(df, "image", "id").collect()}
    assert (out[1].width, out[1].height, out[1].error) == (7, 5, None) and out[1].dhash == out[2].dhash and bytes(out[1].tile) == bytes(out[2].tile)
    assert all(out[i].error and out[i].tile is None for i in (3, 4, 5, 6))


def test_whole_query_on_odd_rows(spark):
    out = media.texts_as_media(docs(spark)).collect()
    want, by_text = [], {}
    for row in rows():
        b = text_of(row).encode()
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        want.append((row[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out], key=key) == sorted(want, key=key)
    stored = {hashlib.sha256(r.media).hexdigest(): bytes(r.media) for r in media.store_texts(docs(spark)).collect()}
    for r in out:
        image, top = media.decode_image(stored[r.media_sha256])
        assert len(stored[r.media_sha256]) == r.media_bytes
        assert bytes(r.tile) == media.npy_tile(image, 16, top) and r.feature.startswith(media.difference_hash(image))
        assert by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.texts_as_media(nothing(spark)).count() == 0
