"""Media columns: payloads as PNG images with perceptual hashes.

Bytes become an 8-bit grey image, 64 samples a row, stored as PNG: chunks with
checksums around a zlib stream of filtered rows. Reading tests the signature,
every chunk's CRC-32, the chunk order and sizes, inflates, and undoes the row
filters in numpy. The feature is a low-frequency cosine-transform hash of the
picture shrunk to 32 x 32.

Defined cases: null or empty text is one row of zero samples; equal texts give
equal files and features; a damaged file raises ValueError; repeated rows each
give their row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm.common import map_texts, table

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Side of the shrunken picture, and of the block of low frequencies hashed.
SIDE, LOW = 32, 8
_GREY8 = (8, 0, 0, 0, 0)
_STRIP = 4096


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(data: bytes, width: int = WIDTH) -> bytes:
    """Zeros up to a positive multiple of the width."""
    return data + bytes(-len(data) % width if data else width)


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """A PNG of the payload, each row stored as differences to the row above."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    filtered = np.empty((len(rows), width + 1), np.uint8)
    filtered[:, 0] = 2
    filtered[0, 1:] = rows[0]
    np.subtract(rows[1:], rows[:-1], out=filtered[1:, 1:])
    head = struct.pack(">II5B", width, len(rows), *_GREY8)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, width: int) -> np.ndarray:
    """Undo the five row filters for one byte a sample.

    Runs of rows with the same filter none, up or sub go at once as running
    sums modulo 256; average and Paeth go sample by sample.
    """
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        kind = int(kinds[a])
        above = rows[a - 1] if a else np.zeros(width, np.uint8)
        if kind == 1:
            rows[a:b] = np.cumsum(rows[a:b], axis=1, dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            for i in range(a, b, _STRIP):
                part = rows[i : min(b, i + _STRIP)]
                part[0] += above
                part[:] = np.cumsum(part, axis=0, dtype=np.uint32).astype(np.uint8)
                above = part[-1]
        elif kind in (3, 4):
            for i in range(a, b):
                left = corner = 0
                for j in range(width):
                    up = int(above[j])
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        p = left + up - corner
                        guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                    left = (int(rows[i, j]) + guess) & 255
                    rows[i, j], corner = left, up
                above = rows[i]
        elif kind:
            raise ValueError(f"unknown row filter {kind}")
    return rows


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG, after testing its structure and sums."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, head, body, ended = len(SIGNATURE), None, [], False
    while at < len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(chunk) < size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + chunk):
            raise ValueError(f"bad checksum in {kind!r}")
        if (head is None) != (kind == b"IHDR"):
            raise ValueError("IHDR must come first, once")
        if kind == b"IHDR":
            head = struct.unpack(">II5B", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            ended = True
        elif kind[0] < 97:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + size
    if not ended or head is None or head[2:] != _GREY8:
        raise ValueError("cut short, or not plain 8-bit grey")
    width, height = head[:2]
    raw = zlib.decompress(b"".join(body))
    if len(raw) != height * (width + 1):
        raise ValueError("the samples don't fill the picture")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1), width)


def _cosines(low: int, side: int) -> np.ndarray:
    return np.cos(np.pi / side * (np.arange(side) + 0.5)[None, :] * np.arange(low)[:, None])


def _shrink(picture: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Mean of side x side cells; cells of a small picture repeat its samples."""
    for axis in (0, 1):
        n = picture.shape[axis]
        edges = np.arange(side) * n // side
        ends = np.maximum((np.arange(side) + 1) * n // side, edges + 1)
        if n >= side:
            picture = np.add.reduceat(picture, edges, axis=axis, dtype=np.float64)
        else:
            picture = np.take(picture, edges, axis=axis).astype(np.float64)
            ends = edges + 1
        picture = picture / np.expand_dims(ends - edges, 1 - axis)
    return picture


_BASIS = _cosines(LOW, SIDE)


def cosine_hash(picture: np.ndarray) -> str:
    """64 bits in hex: which low frequencies lie over their median, the mean left out."""
    low = np.round(_BASIS @ _shrink(picture) @ _BASIS.T, 6)
    over = low > np.median(low.ravel()[1:])
    over[0, 0] = False
    return np.packbits(over).tobytes().hex()


def media_columns(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each document with its picture as a binary column and what reading it gives."""

    def start() -> Callable[[str], tuple]:
        def row(text: str) -> tuple:
            data = text.encode("utf-8", "surrogatepass")
            media = encode_png(pad(data, width), width)
            picture = decode_png(media)
            payload = picture.tobytes()
            return (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(picture), media)

        return row

    return map_texts(docs, start, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents")).drop("media")
