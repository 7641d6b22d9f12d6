"""Media columns: 8-bit grey PNG images in binary columns, written and read chunk by chunk.

A payload becomes an image 576 samples wide. Rows are filtered (Sub for the first row, Up below it), deflated and put into
IHDR, IDAT and IEND chunks with their CRC-32. Reading walks the chunks, tests every checksum, inflates and undoes all five
row filters with numpy. Both happen in jobs of their own
with the written column between them. The feature is the 64-bit low-frequency hash: the image is averaged to 32 x 32, transformed by a
two-dimensional cosine transform, and the signs of its lowest 8 x 8 coefficients against their median are the bits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylens.llm.common import map_texts, materialize

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRID, LOW = 32, 8
_N = np.arange(GRID)
#: Rows of the cosine transform (type II) for the lowest frequencies.
COSINES = np.cos(np.pi * (2 * _N[None, :] + 1) * np.arange(LOW)[:, None] / (2 * GRID))


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """Bytes 255 up to a positive multiple of ``width``."""
    return data + b"\xff" * (max(1, -(-len(data) // width)) * width - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = np.empty((len(rows), width + 1), np.uint8)
    out[0, 0], out[1:, 0] = 1, 2
    out[0, 1:] = np.diff(rows[0], prepend=np.uint8(0))
    out[1:, 1:] = rows[1:] - rows[:-1]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfiltered(lines: np.ndarray, width: int) -> np.ndarray:
    """Undoes the filter of each row of 8-bit samples.

    A sample depends on those left, above and above left of it, all on the two diagonals before its own, so a diagonal is
    undone at once. Images of Sub and Up rows alone are sums along rows and down columns.
    """
    kinds, rows = lines[:, 0], lines[:, 1:]
    if (kinds > 4).any():
        raise ValueError(f"unknown row filter {kinds.max()}")
    if (kinds[1:] == 2).all() and kinds[0] <= 2:
        rows = rows.copy()
        if kinds[0] == 1:
            rows[0] = np.cumsum(rows[0], dtype=np.uint8)
        return np.cumsum(rows, axis=0, dtype=np.uint8)
    height = len(rows)
    done = np.zeros((height + 1, width + 1), np.int16)  # a border of zeros above and on the left
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height - 1, d) + 1)
        x = d - y
        left, up, corner, kind = done[y + 1, x], done[y, x + 1], done[y, x], kinds[y]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        near = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        done[y + 1, x + 1] = (rows[y, x] + np.choose(kind, (0, left, up, (left + up) // 2, near))) & 255
    return done[1:, 1:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey, non-interlaced PNG; ValueError for anything else or a wrong checksum."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body = 8, None, []
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + part)):
            raise ValueError(f"wrong checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    width, height = head[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return _unfiltered(lines, width)


def _averaged(image: np.ndarray, axis: int) -> np.ndarray:
    """Means of GRID even slices along an axis; a slice without a sample of its own takes the nearest."""
    n = image.shape[axis]
    edges = np.arange(GRID) * n // GRID
    if n < GRID:
        return np.take(image, edges, axis)
    sizes = np.diff(edges, append=n)
    sums = np.add.reduceat(image, edges, axis)
    return sums / (sizes[:, None] if axis == 0 else sizes[None, :])


def cosine_hash(image: np.ndarray) -> bytes:
    small = _averaged(_averaged(image.astype(np.int64), 1), 0).astype(np.float64)
    low = np.round(COSINES @ small @ COSINES.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes()


def encode_images(docs: DataFrame, width: int = WIDTH, level: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: the PNG of each text. Null texts count as empty: one row of 255s."""
    def make():
        def work(texts: list) -> list:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            return [[len(d) for d in data], [encode_png(padded(d, width), width, level) for d in data]]

        return work

    return map_texts(docs, make, "n_bytes bigint, media binary", id_col, text_col, rows=64)


def read_images(images: DataFrame) -> DataFrame:
    """Sizes, digests, checksum of the tail and the feature of each image of ``media``, beside ``doc_id, n_bytes``."""
    def make():
        def work(stored: list) -> list:
            out: list[list] = [[] for _ in range(6)]
            for media in stored:
                image = decode_png(media)
                payload = image.tobytes()
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image).hex())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return work

    named = images.select(F.struct("doc_id", "n_bytes").alias("row"), "media")
    columns = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_texts(named, make, columns, "row", "media", rows=64).select("doc_id.*", *[c.split()[0] for c in columns.split(", ")])


def image_columns(docs: DataFrame, width: int = WIDTH, level: int = 6, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The stored images, ``doc_id, n_bytes, media``, and what was read back from them, ``doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.

    Images are written to the shared folder as a binary column; features come from those bytes. Null texts count as
    empty; equal texts give equal bytes and features; repeated rows and null ids are kept row by row, texts of any
    length are stored whole, an empty table gives no rows. Other columns aren't read.
    """
    stored = materialize(encode_images(docs, width, level, id_col, text_col), "media")
    return stored, read_images(stored)
