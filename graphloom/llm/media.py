"""Media columns: Netpbm and BMP to arrays, area-resized tiles in NPY form, difference hashes.

``media_features`` takes a binary column of images, decodes each (PBM, PGM and
PPM, plain and raw; BMP of 8, 24 or 32 bits, uncompressed) to a numpy array,
resizes it by exact area means taken from an integral image, and returns the
tile as NPY bytes and a difference hash.  ``text_media`` stores texts as raw
PGM (or 8-bit BMP) images of 64 samples a row, which is lossless.

Texts are taken in slices of 1 MB; a very long text is a slice of its own, and
takes some four times its bytes (read, padded, stored, read back).

Defined cases: a null or empty text is one row of 64 zero samples; a null or
unreadable image has null features and a reason in ``error``; equal media, and
so repeated rows, have equal features; an empty table gives an empty one; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import sliced, table

ROW = 64
TILE = (8, 9)


def encode_pgm(samples: np.ndarray) -> bytes:
    """An 8-bit grey image as raw PGM."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, dtype=np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit grey image as BMP with a grey palette, bottom row first."""
    height, width = samples.shape
    stride = -(-width // 4) * 4
    rows = np.zeros((height, stride), dtype=np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    return struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def _header(raw: bytes, count: int) -> tuple[list[int], int]:
    """``count`` numbers after the magic number, and where the samples begin; # starts a comment."""
    at, out = 2, []
    while len(out) < count:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(raw, at)
        if not m:
            raise ValueError("the Netpbm header is cut short")
        out.append(int(m[1]))
        at = m.end()
    return out, at + 1


def decode_netpbm(raw: bytes) -> np.ndarray:
    kind = raw[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bitmap, depth = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    numbers, at = _header(raw, 2 if bitmap else 3)
    width, height, most = numbers[0], numbers[1], 1 if bitmap else numbers[2]
    if not 0 < most < 65536:
        raise ValueError("the largest sample is out of range")
    shape = (height, width, 3) if depth == 3 else (height, width)
    if kind == b"P4":
        stride = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, stride * height, at).reshape(height, stride), axis=1)[:, :width]
        return (1 - bits) * np.uint8(255)
    if kind in (b"P1", b"P2", b"P3"):
        text = re.sub(rb"#[^\n]*", b"", raw[at - 1 :])
        values = np.array([int(x) for x in (re.findall(rb"[01]", text) if bitmap else text.split())][: height * width * depth])
        values = values.reshape(shape)
        return ((1 - values) * 255).astype(np.uint8) if bitmap else values.astype(np.uint8 if most < 256 else np.uint16)
    kind_of = np.dtype(np.uint8) if most < 256 else np.dtype(">u2")
    return np.frombuffer(raw, kind_of, height * width * depth, at).reshape(shape)


def decode_bmp(raw: bytes) -> np.ndarray:
    start, head = struct.unpack_from("<I", raw, 10)[0], struct.unpack_from("<I", raw, 14)[0]
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", raw, 18)
    if packed not in (0, 3) or bits not in (8, 24, 32) or width <= 0:
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits is read")
    stride, down = -(-width * bits // 32) * 4, height > 0
    rows = np.frombuffer(raw, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = (rows[::-1] if down else rows)[:, : width * bits // 8]
    if bits == 8:
        used = struct.unpack_from("<I", raw, 46)[0] or 256
        palette = np.frombuffer(raw, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
        image = palette[rows]
        return image[:, :, 0] if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all() else image
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, from an integral image at fractional corners.

    Only those rows of the integral image are made that corners lie in, so the
    work memory is that of a few rows, however long the image is.
    """
    rows, columns = image.shape[:2]
    y, x = np.linspace(0, rows, height + 1), np.linspace(0, columns, width + 1)

    def at(axis: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.minimum(axis.astype(np.int64), most - 1)
        return low, axis - low

    def grey(line: np.ndarray) -> np.ndarray:
        return line if image.ndim == 2 else line[:, :3] @ np.array([0.299, 0.587, 0.114])

    (y0, fy), (x0, fx) = at(y, rows), at(x, columns)
    total, above, done = np.zeros((height + 1, columns + 1)), np.zeros(image.shape[1:]), 0
    for k, (row, part) in enumerate(zip(y0.tolist(), fy.tolist(), strict=True)):
        above = above + image[done:row].sum(axis=0, dtype=np.int64)
        done = row
        np.cumsum(grey(above + part * image[row].astype(np.float64)), out=total[k, 1:])
    corners = total[:, x0] * (1 - fx) + total[:, x0 + 1] * fx
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums / (np.diff(y)[:, None] * np.diff(x)[None, :])


def difference_hash(tile: np.ndarray) -> str:
    """One bit for each two neighbours in a row: is the right one lighter?"""
    bits = np.round(tile[:, 1:], 6) > np.round(tile[:, :-1], 6)
    return np.packbits(bits.ravel()).tobytes().hex()


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def features(raw: bytes, tile: tuple[int, int] = TILE) -> tuple[np.ndarray, np.ndarray, str]:
    """The decoded image, its tile (8-bit) and its difference hash."""
    image = decode(raw)
    small = area_resize(image, *tile)
    return image, np.clip(np.rint(small), 0, 255).astype(np.uint8), difference_hash(small)


def media_features(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = (), tile: tuple[int, int] = TILE) -> DataFrame:
    """The columns ``keep`` and height, width, channels, tile (NPY bytes), feature and error of each image."""

    def run(batches):
        for batch in batches:
            rows = []
            for raw in batch.column(len(keep)).to_pylist():
                try:
                    if raw is None:
                        raise ValueError("no image")
                    image, small, feature = features(raw, tile)
                    rows.append((*image.shape[:2], 1 if image.ndim == 2 else image.shape[2], npy_bytes(small), feature, None))
                except (ValueError, struct.error, IndexError) as e:
                    rows.append((None, None, None, None, None, str(e)[:200] or type(e).__name__))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*keep, "height", "width", "channels", "tile", "feature", "error"])

    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(*keep, F.col(media_col)).mapInArrow(run, f"{kept}height int, width int, channels int, tile binary, feature string, error string")


FORMATS = {"pgm": encode_pgm, "bmp": encode_bmp}
_STORED = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "tile": pa.binary(), "media": pa.binary()}


def _store_and_read(kind: str, names: list[str]):
    """Texts (column 1) to stored images, and what those give when read back; the media itself only if it is asked for."""

    def run(batches):
        for batch, data, offs in sliced(batches, 1):
            made: dict[str, list] = {n: [] for n in names}
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                size = b - a
                payload = np.zeros(max(ROW, -(-size // ROW) * ROW), np.uint8)
                payload[:size] = data[a:b]
                media = FORMATS[kind](payload.reshape(-1, ROW))
                del payload
                image, small, mark = features(media)
                back = np.ascontiguousarray(image).reshape(-1)
                row = {
                    "n_bytes": size, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-ROW:]),
                    "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": mark, "tile": npy_bytes(small), "media": media,
                }
                for n in names:
                    made[n].append(row[n])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[n], _STORED[n]) for n in names)], ["id", *names])

    return run


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", kind: str = "pgm", with_media: bool = True) -> DataFrame:
    """Each text as a stored image (``media``, of ``kind`` pgm or bmp), its tile as NPY bytes, and the digests of what is read back."""
    names = [n for n in _STORED if with_media or n != "media"]
    schema = ", ".join(f"{n} {'long' if _STORED[n] == pa.int64() else 'binary' if _STORED[n] == pa.binary() else 'string'}" for n in names)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_store_and_read(kind, names), f"id {docs.schema[id_col].dataType.simpleString()}, {schema}")
    return out.withColumnRenamed("id", id_col)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all ``documents`` stored as media, with their NPY tiles."""
    return text_media(table(spark, sf_dir, "documents").select("doc_id", "text"), with_media=False)
