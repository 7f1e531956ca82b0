"""Media columns: Netpbm and BMP images in binary columns, NPY tiles and difference hashes."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_fields

#: Bytes of a payload's row: 64 pixels of three samples, a multiple of 4 as BMP asks for.
ROW = 192


def encode_ppm(pixels: np.ndarray) -> bytes:
    """height x width x 3 samples as binary PPM."""
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """height x width x 3 samples (red, green, blue) as a 24-bit BMP, rows from the bottom, padded to 4 bytes."""
    h, w, _ = pixels.shape
    stride = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    head = struct.pack("<2sIHHI", b"BM", 54 + h * stride, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, h * stride, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def _netpbm_fields(data: bytes, n: int) -> tuple[list[int], int]:
    """The n numbers of a Netpbm head after its magic, and the place after the white space that ends it."""
    fields, at = [], 2
    while len(fields) < n:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    return fields, at + 1


def decode(data: bytes | None) -> np.ndarray | None:
    """height x width x channels samples of a Netpbm (P1 to P6, 8 bit) or BMP (24 or 32 bit) image; None if it is neither or broken."""
    try:
        magic = data[:2]
        if magic == b"BM":
            (start,) = struct.unpack_from("<I", data, 10)
            _, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
            if packed or bits not in (24, 32):
                return None
            k, stride = bits // 8, (bits * w + 31) // 32 * 4
            rows = np.frombuffer(data, np.uint8, abs(h) * stride, start).reshape(abs(h), stride)[:, : k * w].reshape(abs(h), w, k)
            return (rows[::-1] if h > 0 else rows)[:, :, [2, 1, 0, 3][:k]]
        kind = int(magic[1:]) if magic[:1] == b"P" else 0
        if not 1 <= kind <= 6:
            return None
        fields, at = _netpbm_fields(data, 2 if kind in (1, 4) else 3)
        w, h, channels = fields[0], fields[1], 3 if kind in (3, 6) else 1
        if kind == 4:
            stride = (w + 7) // 8
            return (255 * (1 - np.unpackbits(np.frombuffer(data, np.uint8, h * stride, at).reshape(h, stride), axis=1)[:, :w])).astype(np.uint8)[:, :, None]
        if kind == 1:
            bits = np.array([c - 48 for c in data[at - 1 :] if c in b"01"][: w * h], np.uint8)
            return (255 * (1 - bits)).reshape(h, w, 1)
        if kind in (2, 3):
            return np.array(data[at - 1 :].split()[: w * h * channels], np.uint8).reshape(h, w, channels)
        return np.frombuffer(data, np.uint8, w * h * channels, at).reshape(h, w, channels) if fields[2] < 256 else None
    except (ValueError, IndexError, TypeError, struct.error, OverflowError):
        return None


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area of each pixel, fractional borders weighed, from one integral image."""
    h, w = pixels.shape[:2]
    total = np.zeros((h + 1, w + 1, pixels.shape[2]))
    np.cumsum(np.cumsum(pixels, 0, dtype=np.float64), 1, out=total[1:, 1:])

    def at(axis: int, places: np.ndarray, x: np.ndarray) -> np.ndarray:
        low = np.minimum(places.astype(np.int64), x.shape[axis] - 2)
        part = (places - low).reshape([-1 if i == axis else 1 for i in range(x.ndim)])
        return np.take(x, low, axis) * (1 - part) + np.take(x, low + 1, axis) * part

    ys, xs = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    total = at(1, xs, at(0, ys, total))
    return np.diff(np.diff(total, axis=0), axis=1) / ((h / height) * (w / width))


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile)
    return out.getvalue()


def difference_hash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits: whether each of 8 x 8 mean greys is darker than its right neighbour."""
    small = area_resize(pixels.astype(np.float64).mean(axis=2, keepdims=True), 8, 9)[:, :, 0]
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def media_columns(df: DataFrame, column: str = "media", tile: int = 16) -> DataFrame:
    """df with height, width, channels, samples (bytes, row by row), tile_npy and dhash of a binary column.

    The tile is the image resized to tile x tile, rounded to 8 bits, as the bytes of an NPY file. A
    null, empty or broken image, or one with no pixels, gives nulls. Columns of df with these names are replaced.
    """
    new = {"height": "integer", "width": "integer", "channels": "integer", "samples": "binary", "tile_npy": "binary", "dhash": "string"}
    df = df.drop(*new)
    schema = with_fields(df.schema, **new)
    names = schema.names
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string()]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):  # the samples of a few hundred images at a time
                b = whole.slice(start, 256)
                rows = []
                for data in b.column(b.schema.get_field_index(column)):
                    p = decode(data.as_py())
                    if p is None or not p.size:
                        rows.append((None,) * 6)
                    else:
                        small = np.rint(area_resize(p, tile, tile)).astype(np.uint8)
                        rows.append((*p.shape, p.tobytes(), npy(small), difference_hash(p)))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return df.mapInArrow(run, schema)


def store_texts(docs: DataFrame) -> DataFrame:
    """docs with n_bytes and media: the text's bytes, padded with spaces to whole rows, as an image.

    The image is 64 pixels wide. Texts with an even CRC become BMP, others PPM, so equal texts give
    equal images. Null texts are empty and give one row of spaces. Columns of docs with these names are replaced.
    """
    docs = docs.drop("n_bytes", "media")
    schema = with_fields(docs.schema, n_bytes="long", media="binary")
    names = schema.names

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                sizes, media = [], []
                for x in b.column(b.schema.get_field_index("text")):
                    data = (x.as_py() or "").encode()
                    pixels = np.frombuffer(data + b" " * (-len(data) % ROW or (0 if data else ROW)), np.uint8).reshape(-1, ROW // 3, 3)
                    sizes.append(len(data))
                    media.append((encode_ppm if zlib.crc32(data) % 2 else encode_bmp)(pixels))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=names)

    return docs.mapInArrow(run, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as an image, read back and hashed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = media_columns(store_texts(docs).drop("text"))
    return x.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -16, 16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "dhash", F.md5("tile_npy")).alias("feature"),
    )
