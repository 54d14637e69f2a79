import hashlib
import math
import statistics
import zlib

import numpy as np
import pytest

from testweave.llm.media import _chunk, SIGNATURE, chosen, cosine_hash, filtered, media_columns, media_digests, pad, read_png, unfilter, write_png

TEXTS = [None, "", "a", "x" * 63, "x" * 64, "é" * 40, "long text " * 30_000, "a"]


@pytest.mark.parametrize("kind", range(5))
def test_filters_round_trip(kind):
    rows = np.random.default_rng(kind).integers(0, 256, (9, 64), dtype=np.uint8)
    assert (unfilter(filtered(rows, kind)) == rows).all()
    assert read_png(write_png(rows.tobytes(), kind)).tobytes() == rows.tobytes()


def test_mixed_filters():
    rows = np.random.default_rng(9).integers(0, 256, (12, 64), dtype=np.uint8)
    kinds = [4, 2, 2, 1, 0, 3, 3, 4, 1, 2, 0, 2]
    lines = np.array([filtered(rows, k)[i] for i, k in enumerate(kinds)])
    assert (unfilter(lines) == rows).all()


def test_filters_are_chosen_by_line():
    rng = np.random.default_rng(4)
    noise = rng.integers(0, 256, (6, 64), dtype=np.uint8)
    ramp = (np.arange(64, dtype=np.uint8)[None, :] + 100) * np.ones((6, 1), np.uint8)
    rows = np.concatenate([np.zeros((2, 64), np.uint8), ramp, noise, noise[-1:], noise[-1:] + 1, ramp, np.frombuffer(("some words of text " * 40).encode()[:640], np.uint8).reshape(-1, 64)])
    lines = chosen(rows)
    assert set(lines[:, 0]) == {0, 1, 2} and (unfilter(lines) == rows).all()
    for _ in range(50):
        n = int(rng.integers(1, 30))
        rows, kinds = rng.integers(0, 256, (n, 64), dtype=np.uint8), rng.integers(0, 5, n)
        assert (unfilter(np.array([filtered(rows, k)[i] for i, k in enumerate(kinds)])) == rows).all()


def plain_hash(rows):
    """The cosine hash from its definition, sample by sample."""
    h, w = len(rows), len(rows[0])
    cut = lambda n, i: range(i * n // 32, max(i * n // 32 + 1, (i + 1) * n // 32))
    small = [[sum(float(rows[y][x]) for y in cut(h, i) for x in cut(w, j)) / (len(cut(h, i)) * len(cut(w, j))) for j in range(32)] for i in range(32)]
    low = [round(sum(small[y][x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = statistics.median(low[1:])
    return int("".join("0" if k == 0 else str(int(c > middle)) for k, c in enumerate(low)), 2).to_bytes(8, "big")


@pytest.mark.parametrize("lines", [1, 7, 32, 45, 64, 200])
def test_hash_equals_its_definition(lines):
    rows = np.random.default_rng(lines).integers(0, 256, (lines, 64), dtype=np.uint8)
    assert cosine_hash(rows) == plain_hash(rows.tolist())


def test_damage_is_found():
    png = write_png(pad(b"some text"))
    for i in range(0, len(png), 3):
        bad = png[:i] + bytes([png[i] ^ 1]) + png[i + 1 :]
        with pytest.raises((ValueError, zlib.error)):
            read_png(bad)
    for cut in (0, 8, 20, len(png) - 1):
        with pytest.raises(ValueError):
            read_png(png[:cut])
    assert SIGNATURE == png[:8] and _chunk(b"IEND", b"") == png[-12:]


def test_columns(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "a", None, 2)], "doc_id long, text string, png string, hash int")
    for r in media_columns(docs).collect():
        t = ("a" if r.doc_id is None else TEXTS[r.doc_id]) or ""
        assert bytes(r.samples) == pad(t.encode()) == read_png(bytes(r.png)).tobytes()
    d = {r.doc_id: r for r in media_digests(docs).collect()}
    for i, t in enumerate(TEXTS):
        p = pad((t or "").encode())
        assert (d[i].n_bytes, d[i].payload_bytes, d[i].payload_sha256, d[i].tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert d[i].media_sha256 == hashlib.sha256(write_png(p)).hexdigest() and d[i].media_bytes == len(write_png(p))
    assert d[2].feature == d[7].feature and len(d[2].feature) == 16
    assert media_digests(docs.limit(0)).count() == 0


def test_hash_keeps_near_images_near():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (200, 64), dtype=np.uint8)
    b = a.copy()
    b[5, :10] ^= 3
    c = rng.integers(0, 256, (200, 64), dtype=np.uint8)
    gap = lambda p, q: bin(int.from_bytes(cosine_hash(p), "big") ^ int.from_bytes(cosine_hash(q), "big")).count("1")
    assert gap(a, b) <= 4 < gap(a, c)
