"""Media columns: Netpbm and BMP images in binary columns.

Images are decoded to numpy arrays of shape (height, width, channels), resized by
area with integral images, and written as NPY tiles with a difference hash. The
integral image is taken over stripes of rows, so memory is bounded by a stripe
besides the samples themselves.

Defined results: a null payload or one that can't be decoded gives nulls in the
computed columns and its reason in ``error`` (``image_features``); null text is the
empty text (``texts_as_media``), stored as one row of zero samples; equal inputs
give equal values, also in rows that repeat; an image of any size is decoded as a
whole, which costs a few times its samples; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphspark.llm._batches import column, slices, utf8, values
from graphspark.session import ensure_importable, materialize

STRIPE = 1 << 20  # samples in one stripe of the integral image
WIDTH = 64  # samples in a row of a text's image


def _netpbm_header(data: bytes, n: int) -> tuple[list[int], int]:
    """``n`` numbers after the magic; comments run from # to the line's end."""
    found, at = [], 2
    while len(found) < n:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            end = data.find(b"\n", at)
            at = len(data) if end < 0 else end + 1
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1  # one white-space byte ends the header


def _plain_samples(data: bytes, n: int, bits: bool) -> np.ndarray:
    body = b"\n".join(line.split(b"#", 1)[0] for line in data.split(b"\n"))
    items = [b"%c" % c for c in b"".join(body.split())] if bits else body.split()
    if len(items) < n:
        raise ValueError("too few samples")
    return np.array(items[:n], dtype=np.int64)


def decode_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """(samples, the value of white) of P1 to P6 and P7 (PAM); samples of up to 16 bits. Bitmaps give 0 for black and 1 for white."""
    kind = data[:2]
    if kind == b"P7":
        head, _, body = data.partition(b"ENDHDR\n")
        fields = dict(line.split(None, 1) for line in head.split(b"\n")[1:] if line.strip() and not line.startswith(b"#"))
        w, h, c, top = (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    elif kind in (b"P1", b"P4"):
        (w, h), at = _netpbm_header(data, 2)
        body, c, top = data[at:], 1, 1
        if kind == b"P1":
            return (1 - _plain_samples(body, w * h, True)).astype(np.uint8).reshape(h, w, 1), 1
        row = -(-w // 8)
        if len(body) < row * h:
            raise ValueError("too few samples")
        return 1 - np.unpackbits(np.frombuffer(body, np.uint8, row * h).reshape(h, row), axis=1)[:, :w].reshape(h, w, 1), 1
    elif kind in (b"P2", b"P3", b"P5", b"P6"):
        (w, h, top), at = _netpbm_header(data, 3)
        body, c = data[at:], 3 if kind in (b"P3", b"P6") else 1
        if not 0 < top < 65536:
            raise ValueError(f"Netpbm of maximal value {top}")
        if kind in (b"P2", b"P3"):
            return _plain_samples(body, w * h * c, False).astype(np.uint16 if top > 255 else np.uint8).reshape(h, w, c), top
    else:
        raise ValueError("not Netpbm")
    if not 0 < top < 65536:
        raise ValueError(f"Netpbm of maximal value {top}")
    kind_of = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
    if len(body) < w * h * c * kind_of.itemsize:
        raise ValueError("too few samples")
    return np.frombuffer(body, kind_of, w * h * c).astype(kind_of.newbyteorder("="), copy=False).reshape(h, w, c), top


def _masked(pixels: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask as 8-bit samples."""
    if not mask:
        return np.zeros(pixels.shape, dtype=np.uint8)
    low = (mask & -mask).bit_length() - 1
    top = mask >> low
    return ((((pixels & np.uint32(mask)) >> np.uint32(low)).astype(np.uint64) * 510 + top) // (2 * top)).astype(np.uint8)


def decode_bmp(data: bytes) -> tuple[np.ndarray, int]:
    """(samples, 255) of an uncompressed BMP of 1, 4, 8 (palette), 16, 24 or 32 bits, bottom-up or top-down; 16 and 32 bits with
    or without masks. What a mask says of transparency is left out."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    start, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if size < 40:
        raise ValueError("BMP of the oldest form")
    if packed not in (0, 3) or packed == 3 and bits not in (16, 32):
        raise ValueError("compressed BMP")
    rows, stride = abs(h), (w * bits + 31) // 32 * 4
    if w <= 0 or len(data) < start + stride * rows:
        raise ValueError("too few samples")
    lines = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits in (1, 4, 8):
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + size).reshape(colours, 4)[:, 2::-1]
        at = lines[:, :w] if bits == 8 else np.unpackbits(lines, axis=1).reshape(rows, -1, bits)[:, :w] @ (1 << np.arange(bits)[::-1])
        image = palette[at]
    elif bits in (16, 32):
        masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
        pixels = np.ascontiguousarray(lines[:, : w * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.uint32)
        image = np.stack([_masked(pixels, m) for m in masks], axis=2)
    elif bits == 24:
        image = lines[:, : w * 3].reshape(rows, w, 3)[:, :, ::-1]
    else:
        raise ValueError(f"BMP of {bits} bits")
    return (image[::-1] if h > 0 else image), 255


def decode_image(data: bytes) -> tuple[np.ndarray, int]:
    """(samples of shape (height, width, channels), the value of white)."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.astype(np.uint8, copy=False).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """A 24-bit BMP of an array (height, width, 3)."""
    h, w, _ = image.shape
    lines = np.zeros((h, (w * 24 + 31) // 32 * 4), dtype=np.uint8)
    lines[:, : w * 3] = image[::-1, :, ::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHI", 54 + lines.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, lines.size, 2835, 2835, 0, 0) + lines.tobytes()


def _edges_in(total: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A running total along axis 0 at fractional places."""
    low = np.floor(cuts).astype(np.int64)
    high = np.minimum(low + 1, total.shape[0] - 1)
    part = (cuts - low).reshape(-1, *[1] * (total.ndim - 1))
    return total[low] * (1 - part) + total[high] * part


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, from an integral image; (height, width, channels) of float64."""
    h, w, c = image.shape
    if not h or not w:
        raise ValueError("empty image")
    row_cuts, column_cuts = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    at_cuts = np.zeros((height + 1, w + 1, c))  # the integral image at the fractional rows
    above = np.zeros((w + 1, c))
    step = max(1, STRIPE // max(1, w * c))
    for top in range(0, h, step):
        part = image[top : top + step]
        total = np.zeros((len(part) + 1, w + 1, c))
        np.cumsum(np.cumsum(part, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
        total += above
        end = top + len(part)
        inside = (row_cuts >= top) & ((row_cuts < end) | (end == h))
        at_cuts[inside] = _edges_in(total, row_cuts[inside] - top)
        above = total[-1]
    corners = _edges_in(at_cuts.transpose(1, 0, 2), column_cuts).transpose(1, 0, 2)
    sums = np.diff(np.diff(corners, axis=0), axis=1)
    return sums / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, row by row: whether a cell of the 8 x 9 resized image is darker than the one to its right."""
    grey = area_resize(image, 8, 9).mean(axis=2)
    bits = np.round(grey[:, 1:], 6) > np.round(grey[:, :-1], 6)
    return np.packbits(bits.reshape(-1)).tobytes().hex()


def npy_tile(image: np.ndarray, side: int, top: int = 255) -> bytes:
    """The area-resized tile of side x side as an NPY file of 8-bit samples; ``top`` is the value of white in the image."""
    tile = np.clip(np.rint(area_resize(image, side, side) * (255 / top)), 0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def image_features(df: DataFrame, image_col: str, id_col: str, side: int = 32) -> DataFrame:
    """id, width, height, channels, tile (NPY bytes), dhash, error per image."""
    ensure_importable(df.sparkSession)
    source = df.select(F.col(id_col).alias("__id"), F.col(image_col).cast("binary").alias("__image"))
    kind = source.schema["__id"].dataType
    schema = pa.schema([("__id", to_arrow_type(kind)), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])

    def features(batches):
        for batch in slices(batches, "__image"):
            rows = []
            for data in values(batch, "__image"):
                try:
                    if data is None:
                        raise ValueError("null")
                    image, top = decode_image(data)
                    h, w, c = image.shape
                    rows.append((w, h, c, npy_tile(image, side, top), difference_hash(image), None))
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((None, None, None, None, None, str(e) or type(e).__name__))
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), *(pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return source.mapInArrow(features, f"__id {kind.simpleString()}, width int, height int, channels int, tile binary, dhash string, error string").withColumnRenamed("__id", id_col)


def text_payload(text: bytes, unit: int = WIDTH) -> bytes:
    """The text and zero bytes up to a positive multiple of ``unit``."""
    return text + b"\0" * (-len(text) % unit if text else unit)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: each text as a grey PGM image of 64 samples a row."""
    ensure_importable(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = source.schema["__id"].dataType
    schema = pa.schema([("__id", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def stored(batches):
        for batch in slices(batches, "__text"):
            texts = utf8(batch, "__text")
            media = [encode_pgm(np.frombuffer(text_payload(t), np.uint8).reshape(-1, WIDTH)) for t in texts]
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return source.mapInArrow(stored, f"__id {kind.simpleString()}, n_bytes long, media binary").withColumnRenamed("__id", id_col)


def read_stored(stored: DataFrame, id_col: str = "doc_id", side: int = 16) -> DataFrame:
    """From stored media: id, n_bytes, media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32 (of the samples
    as decoded), feature (difference hash and digest of the NPY tile) and tile (NPY)."""
    ensure_importable(stored.sparkSession)
    source = stored.select(F.col(id_col).alias("__id"), "n_bytes", "media")
    kind = source.schema["__id"].dataType
    names = [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string()), ("tile", pa.binary())]
    schema = pa.schema([("__id", to_arrow_type(kind)), ("n_bytes", pa.int64()), *names])

    def read(batches):
        for batch in slices(batches, "media"):
            rows = []
            for media in values(batch, "media"):
                image, top = decode_image(media)
                back = image.tobytes()
                tile = npy_tile(image, side, top)
                rows.append((len(media), hashlib.sha256(media).hexdigest(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), f"{difference_hash(image)}:{hashlib.sha256(tile).hexdigest()[:16]}", tile))
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), column(batch, "n_bytes"), *(pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(schema)[2:], strict=True))], schema=schema)

    return source.mapInArrow(read, f"__id {kind.simpleString()}, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, tile binary").withColumnRenamed("__id", id_col)


def texts_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", side: int = 16) -> DataFrame:
    """Writes the texts' media as a table in the shared folder, then reads them back and computes what ``read_stored`` says."""
    return read_stored(materialize(store_texts(docs, id_col, text_col), "media"), id_col, side)
