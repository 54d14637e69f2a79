"""Media columns: losslessly stored PNG in binary columns, read back by chunk, and low-frequency cosine hashes.

A payload becomes the 8-bit grey samples of a PNG that is 64 samples wide. The reader walks the chunks, tests every
checksum, inflates the image data and undoes the line filters with numpy: the writer chooses for each line the filter
(none, left, up) whose differences are smallest, and the reader takes cumulative sums over all lines at once; the two
filters that depend on decoded neighbours both ways, which other writers use, run by line. The hash is the sign pattern of
the lowest 8 x 8 frequencies of a cosine transform of the samples, shrunk to 32 x 32 by area means.

Each row is handled alone: no shuffle, one image in memory at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
SIDE, LOW = 32, 8


def pad(data: bytes, to: int = WIDTH) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``to``."""
    return data + bytes(-len(data) % to or (0 if data else to))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """Lines with filter 0 (none), 1 (left), 2 (up), 3 (mean) or 4 (Paeth) applied, each behind its filter byte."""
    left = np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    if kind == 0:
        out = rows
    elif kind == 1:
        out = rows - left
    elif kind == 2:
        out = rows - up
    elif kind == 3:
        out = rows - ((left.astype(np.uint16) + up) // 2).astype(np.uint8)
    else:
        corner = np.zeros_like(rows)
        corner[1:, 1:] = rows[:-1, :-1]
        out = rows - _paeth(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)
    return np.concatenate([np.full((len(rows), 1), kind, np.uint8), out], axis=1)


def _paeth(a, b, c):
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def chosen(rows: np.ndarray) -> np.ndarray:
    """Lines behind their filter bytes, each with the one of filters 0 to 2 that leaves the smallest sum of differences (as signed bytes)."""
    all_ = np.stack([filtered(rows, k) for k in range(3)])
    size = np.abs(all_[:, :, 1:].view(np.int8).astype(np.int16)).sum(axis=2)
    return all_[size.argmin(axis=0), np.arange(len(rows))]


def write_png(payload: bytes, kind: int | None = None, level: int = 6) -> bytes:
    """A grey 8-bit PNG whose samples are ``payload`` (a positive multiple of 64 bytes), 64 in a line; filters by line, or one for all."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    lines = chosen(rows) if kind is None else filtered(rows, kind)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered lines (a filter byte before each)."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown line filter")
    left = kinds == 1
    rows[left] = np.cumsum(rows[left], axis=1, dtype=np.uint8)
    last = 0
    for r in [*np.flatnonzero(kinds >= 3).tolist(), len(rows)]:
        _add_up(rows, kinds, last, r)
        if r < len(rows):
            _by_sample(rows, r, kinds[r] == 4)
        last = r + 1
    return rows


def _add_up(rows: np.ndarray, kinds: np.ndarray, start: int, end: int) -> None:
    """Undo filter 2 in lines start to end: sums since the last line of another filter, and that line."""
    up = kinds[start:end] == 2
    if not up.any():
        return
    part = rows[start:end]
    base = np.maximum.accumulate(np.where(up, -1, np.arange(end - start)))
    total = np.cumsum(np.where(up[:, None], part, 0), axis=0, dtype=np.uint8)
    before = np.concatenate([rows[start - 1 : start] if start else np.zeros((1, part.shape[1]), np.uint8), part])
    offset = np.concatenate([np.zeros((1, part.shape[1]), np.uint8), total])
    part[up] = before[base[up] + 1] + total[up] - offset[base[up] + 1]


def _by_sample(rows: np.ndarray, r: int, paeth: bool) -> None:
    """Undo filter 3 or 4 of one line, whose samples depend on each other."""
    up = rows[r - 1].tolist() if r else [0] * rows.shape[1]
    out, left, corner = [], 0, 0
    for v, above in zip(rows[r].tolist(), up):
        if paeth:
            near, high, far = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
            guess = left if near <= high and near <= far else above if high <= far else corner
        else:
            guess = (left + above) // 2
        left, corner = (v + guess) & 255, above
        out.append(left)
    rows[r] = out


def read_png(png: bytes) -> np.ndarray:
    """Samples (lines x width) of a grey 8-bit PNG; ValueError where signature, order, checksum or sizes are wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, body, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise ValueError("cut chunk")
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(data) < n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            w, h, *rest = struct.unpack(">IIBBBBB", data)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only grey 8-bit without interlace")
            size = (h, w)
        elif kind == b"IDAT":
            body.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise ValueError("incomplete PNG")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(lines) != size[0] * (size[1] + 1):
        raise ValueError("wrong image size")
    return unfilter(lines.reshape(size[0], size[1] + 1))


def _basis() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


def _shrink(a: np.ndarray) -> np.ndarray:
    """32 rows of area means along the first axis (rows repeat where there are fewer)."""
    n = len(a)
    if n < SIDE:
        return a[np.arange(SIDE) * n // SIDE]
    cuts = np.arange(SIDE) * n // SIDE
    return np.add.reduceat(a, cuts, axis=0) / np.diff(np.append(cuts, n))[:, None]


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: which of the 64 lowest frequencies lie above their median (the constant one set aside)."""
    small = _shrink(_shrink(samples.astype(np.float64)).T).T
    basis = _basis()
    low = np.round(basis @ small @ basis.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> DataFrame:
    """doc_id, n_bytes, png (binary), samples (binary: read back from png), hash (binary, 8 bytes) for each row.

    A null text counts as empty and becomes one line of zeros. Repeated rows give equal values; other columns are
    ignored; an empty table gives an empty result.
    """

    def run(batches):
        for b in slices(batches, 64):
            n, png, back, hashes = [], [], [], []
            for t in b["text"].to_pylist():
                data = (t or "").encode()
                stored = write_png(pad(data), level=level)
                samples = read_png(stored)
                n.append(len(data))
                png.append(stored)
                back.append(samples.tobytes())
                hashes.append(cosine_hash(samples))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(png, pa.binary()), pa.array(back, pa.binary()), pa.array(hashes, pa.binary())], names=["doc_id", "n_bytes", "png", "samples", "hash"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, png binary, samples binary, hash binary")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of :func:`media_columns`, computed by Spark's own functions from its binary columns."""
    m = media_columns(docs, id_col, text_col)
    return m.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64, 64)")).alias("tail_crc32"),
        F.octet_length("png").cast("long").alias("media_bytes"),
        F.sha2("png", 256).alias("media_sha256"),
        F.lower(F.hex("hash")).alias("feature"),
    )
