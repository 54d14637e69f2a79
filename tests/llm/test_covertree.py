import math

import numpy as np

from testweave.llm.covertree import near_embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def brute(rows, limit=0.95):
    ok = {}
    for i, (vid, v, *_) in enumerate(rows):
        if vid is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            ok[i] = np.array(v, dtype=np.float32).astype(float)
    n, root = {i: 0 for i in range(len(rows))}, {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ok:
        for j in ok:
            if i < j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= limit:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i in ok:
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    out = []
    for i, r in enumerate(rows):
        c = low[find(i)] if i in ok else r[0]
        out.append((r[0], n[i], c, r[0] is None or r[0] == c))
    return sorted(out, key=str)


def check(spark, rows):
    got = [tuple(r) for r in near_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_matches_brute_force(spark, monkeypatch):
    from testweave.llm import covertree

    monkeypatch.setattr(covertree, "BLOCK", 60)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 8))
    rows = []
    for i in range(300):
        v = centres[i % 5] + rng.normal(size=8) * (0.05, 0.3, 1.0, 0.02, 0.12)[i % 5]
        rows.append((i * 3 + 1, [float(np.float32(c)) for c in v], i, "x"))
    rows += [(2000 + i, rows[7][1], 0, "x") for i in range(70)]
    check(spark, rows)


def test_rounds_shuffle_a_bounded_number_of_blocks(spark, monkeypatch):
    """Each pair of tiles is met once, whatever rounds it falls into, and no round sends out more than twice the blocks."""
    from testweave.llm import covertree

    for n in (20, 400, 4000):
        size, rounds = covertree._rounds([(8, a, b, n // 10, n // 10) for a in range(10) for b in range(a, 10)], n)
        tiles = -(-(n // 10) // size)
        rows = [r for some in rounds for r in some]
        assert sorted(rows) == sorted((8, a, b, t, tiles) for a in range(10) for b in range(a, 10) for t in range(tiles))
        assert all(sum(size * r[4] + n // 10 for r in some) <= max(2 * n, covertree.ROUND) + (len(some) == 1) * 2 * n for some in rounds)
    for k, v in (("BLOCK", 20), ("ROUND", 4), ("TILE", 1), ("PARTS", 3)):
        monkeypatch.setattr(covertree, k, v)
    written = []
    monkeypatch.setattr(covertree, "materialize", lambda df, name, f=covertree.materialize: written.append(name) or f(df, name))
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(3, 8))
    rows = [(i + 1, [float(np.float32(c)) for c in centres[i % 3] + rng.normal(size=8) * (0.05, 0.12, 0.3)[i % 3]], 0, None) for i in range(160)]
    check(spark, rows)
    assert written.count("links") > 4


def test_tiles_of_several_blocks(spark, monkeypatch):
    from testweave.llm import covertree

    monkeypatch.setattr(covertree, "BLOCK", 12)
    monkeypatch.setattr(covertree, "_rounds", lambda pairs, n, f=covertree._rounds: f(pairs, 16 * covertree.TILE * 3))
    rng = np.random.default_rng(3)
    rows = [(i + 1, [float(np.float32(c)) for c in rng.normal(size=4) * 0.2 + 1], 0, None) for i in range(150)]
    check(spark, rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0, None), (2, [], 0, None), (3, [0.0, 0.0], 0, ""), (4, [1.0, None], None, None), (5, [nan, 1.0], 0, None), (6, [inf, 1.0], 0, None), (7, [1.0, 0.0], 0, None), (8, [2.0, 0.0], 0, None), (9, [1.0], 0, None), (10, [-1.0, 0.0], 0, None), (None, [1.0, 0.0], 0, None)]
    check(spark, rows)


def test_empty_table(spark):
    assert near_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0
