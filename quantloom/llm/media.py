"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import materialize, small_batches, table

ROW_BYTES = 192
TAIL_BYTES = 16
TILE_SIDE = 32


def _netpbm_fields(data: bytes, count: int) -> tuple[list[int], int]:
    """The header's numbers after the magic, and where the samples begin; # starts a comment."""
    fields, at = [], 2
    while len(fields) < count:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d{1,9})(?!\d)").match(data, at)
        if not m:
            raise ValueError("Netpbm: a header number is missing or out of range")
        fields.append(int(m[1]))
        at = m.end()
    return fields, at + 1


def _samples(data: bytes, kind, count: int, at: int) -> np.ndarray:
    """count samples from byte at on, after a look whether so many are there."""
    if count <= 0 or at < 0 or count * np.dtype(kind).itemsize > len(data) - at:
        raise ValueError("the header asks for more samples than there are, or for none")
    return np.frombuffer(data, kind, count, at)


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (height, width, channels) of 8 or, for maxima over 255, 16 bits, the maximum at the type's own.

    P1 and P4 give 0 for black and 255 for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bitmap, channels = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    fields, at = _netpbm_fields(data, 2 if bitmap else 3)
    width, height, top = fields[0], fields[1], 1 if bitmap else fields[2]
    n = width * height * channels
    if not 0 < top < 65536:
        raise ValueError("Netpbm: the greatest sample is out of range")
    if kind == b"P4":
        packed = _samples(data, np.uint8, -(-width // 8) * height, at).reshape(height, -1)
        samples = np.unpackbits(packed, axis=1)[:, :width]
    elif kind in (b"P5", b"P6"):
        samples = _samples(data, np.uint8 if top < 256 else ">u2", n, at)
    else:
        found = re.findall(rb"[01]" if bitmap else rb"\d+", re.sub(rb"#[^\n]*", b"", data[at - 1:]))
        if not 0 < n <= len(found):
            raise ValueError("Netpbm: samples are missing")
        samples = np.array([int(x.lstrip(b"0")[:6] or 0) for x in found[:n]])
    samples = samples.reshape(height, width, channels)
    if bitmap:
        return ((1 - samples) * 255).astype(np.uint8)
    if samples.max() > top:
        raise ValueError("Netpbm: a sample is over the maximum")
    full = 255 if top < 256 else 65535
    samples = samples if top == full else (samples.astype(np.int64) * full + top // 2) // top
    return samples.astype(np.uint8 if top < 256 else np.uint16)


def encode_ppm(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (width, height) + pixels.astype(np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 16, 24 or 32 bits a pixel, with bit fields too, as an array (height, width, 3),
    red first."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    offset, header, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if header < 40 or bits not in (8, 16, 24, 32) or packing not in (0, 3) or (packing == 3 and bits not in (16, 32)):
        raise ValueError(f"BMP with {bits} bits a pixel and compression {packing} is not supported")
    if width <= 0 or height == 0:
        raise ValueError("BMP without pixels")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = _samples(data, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        palette = _samples(data, np.uint8, (offset - 14 - header) // 4 * 4, 14 + header).reshape(-1, 4)
        places = rows[:, :width]
        if places.max() >= len(palette):
            raise ValueError("BMP: a pixel is outside the palette")
        return palette[places, 2::-1]
    if bits == 24 or (bits == 32 and packing == 0):
        return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    masks = struct.unpack_from("<III", data, 54) if packing == 3 else (0x7C00, 0x3E0, 0x1F)  # red, green, blue
    pixels = np.ascontiguousarray(rows[:, : width * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.int64)
    out = np.empty((*pixels.shape, 3), np.uint8)
    for k, mask in enumerate(masks):
        if not mask:
            raise ValueError("BMP: a bit field is empty")
        low = (mask & -mask).bit_length() - 1
        top = mask >> low
        out[:, :, k] = (((pixels & mask) >> low) * 255 + top // 2) // top
    return out


def encode_bmp(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell, cut cells by their share, from the integral image."""
    integral = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    np.cumsum(np.cumsum(gray, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])

    def along(table: np.ndarray, parts: int) -> np.ndarray:
        edges = np.linspace(0, table.shape[0] - 1, parts + 1)
        low = np.minimum(edges.astype(np.int64), table.shape[0] - 2)
        share = (edges - low)[:, None]
        return table[low] * (1 - share) + table[low + 1] * share

    corners = along(along(integral, height).T, width).T
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums * (height * width / gray.size)


def to_gray(pixels: np.ndarray) -> np.ndarray:
    """The channels' mean, from 0 to 255 also for samples of 16 bits."""
    return pixels.mean(axis=2) / (257 if pixels.dtype == np.uint16 else 1)


def difference_hash(gray: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 by 9 thumbnail is brighter than the one to its left; 16 hex digits."""
    small = np.round(area_resize(gray, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(gray: np.ndarray, side: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.round(area_resize(gray, side, side)).clip(0, 255).astype(np.uint8))
    return out.getvalue()


def text_to_media(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes, padded with spaces to a positive multiple of 192, as the samples of a picture 64 pixels wide: a PPM
    where the rows are even in number, else a BMP."""
    raw = (text or "").encode()
    rows = max(1, -(-len(raw) // ROW_BYTES))
    pixels = np.frombuffer(raw.ljust(rows * ROW_BYTES, b" "), np.uint8).reshape(rows, ROW_BYTES // 3, 3)
    return len(raw), encode_bmp(pixels) if rows % 2 else encode_ppm(pixels)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, n_bytes, media: one picture a document, with the id and the length before padding.

    Null text counts as empty, null ids stay null, repeated rows come out repeated, equal texts give equal pictures; other
    columns of docs are left out; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_to_media(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())],
                ["doc_id", "n_bytes", "media"])

    return slim.mapInArrow(task, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame, tile_side: int | None = TILE_SIDE) -> DataFrame:
    """Decode each row of (doc_id, n_bytes, media): digests of samples and stored bytes, a difference hash, and an NPY
    tile of tile_side by tile_side grey samples, left out where that is None.

    A null or malformed medium gives nulls in all of these, equal media give equal values. Null ids and repeated rows come
    out as they are, other columns of media are left out, an empty table gives no rows.
    """
    small_batches(media.sparkSession)
    columns = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
               "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "tile": pa.binary()}
    names = [c for c in columns if c != "tile" or tile_side]

    def features(data: bytes | None) -> tuple:
        try:
            pixels = decode(data)
        except (TypeError, ValueError, struct.error):
            return (None,) * len(names)
        payload, gray = pixels.tobytes(), to_gray(pixels)
        row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL_BYTES:]), len(data),
               hashlib.sha256(data).hexdigest(), difference_hash(gray))
        return row + ((npy_tile(gray, tile_side),) if tile_side else ())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x) for x in batch.column("media").to_pylist()]
            made = [pa.array([r[i] for r in rows], columns[c]) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *made], ["doc_id", "n_bytes", *names])

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        task, "doc_id long, n_bytes long, " + ", ".join(f"{c} {kinds[columns[c]]}" for c in names))


def op8_media(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and the length and digest of each NPY tile."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = media_features(materialize(store_texts(docs), "media"))
    return rows.withColumns({"tile_bytes": F.octet_length("tile").cast("long"), "tile_sha256": F.sha2("tile", 256)}).drop("tile")
