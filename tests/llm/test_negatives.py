import math

import numpy as np
import pytest

from testweave.llm import negatives
from testweave.llm.negatives import Tiles, Tree, build, mine_negatives, search


def brute(rows, positives=5, count=10):
    """Straight from the definition, in Python's integers."""
    kept = []
    for at, (i, v, label) in enumerate(rows):
        if i is None or v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept.append((at, i, [math.floor(256 * c) for c in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for at, a, q, label in kept:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i, own) for k, i, v, own in kept if k != at]
        for p, positive, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fits = sorted(s[:2] for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)[:count]
            out += [(a, positive, r + 1, i, -p, -s) for r, (s, i) in enumerate(fits)]
    return sorted(out)


def made(rng, n, dim, spread=1.0, labels=4, copies=0):
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))
    if copies:
        x[: n // copies] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), [float(np.float32(c)) for c in v], int(k)) for i, v, k in zip(rng.permutation(n * 3)[:n], x, rng.integers(0, labels, n))]


def frame(spark, rows, names="vec_id long, embedding array<float>, label int"):
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("copies", [0, 3])
def test_equals_brute_force(spark, monkeypatch, copies):
    monkeypatch.setattr(negatives, "BLOCK", 200)
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    rows = made(np.random.default_rng(copies), 1500, 9, spread=0.4, copies=copies)
    got = mine_negatives(frame(spark, rows).repartition(5))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    got = sorted(map(tuple, got.collect()))
    assert got == brute(rows) and len(got) > 50


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = made(rng, 300, 4)
    rows += [(None, [1.0, 0.0, 0.0, 0.0], 1), (900, None, 1), (901, [1.0, 0.0, 0.0, 0.0], None), (902, [1.0, None, 0.0, 0.0], 1), (903, [float("nan"), 0.0, 0.0, 0.0], 1), (904, [float("inf"), 0.0, 0.0, 0.0], 1), (1000, [0.5, 0.1], 1), (1001, [], 2), (1100, [], 3), (1200, [0.0, 0.0, 0.0, 0.0], 2)]
    rows += rows[:40] + [(1300, [3.0e30, -2.0e29, 1.0, 0.0], 1), (1301, [1.0e30, 1.0e29, -3.0, 0.0], 1), (1302, [2.0e-30, 0.0, 1.0, 5.0], 2)]
    clash = [(*r, "x", 1, r[0]) for r in rows]
    got = sorted(map(tuple, mine_negatives(frame(spark, clash, "vec_id long, embedding array<float>, label int, tag string, tile int, x long")).collect()))
    pad = [(i, None if v is None else [*v, *[0.0] * (4 - len(v))], k) for i, v, k in rows]
    pad = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], k) for i, v, k in pad]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = sorted((a, p, r, n, clip(s), clip(t)) for a, p, r, n, s, t in brute(pad))
    # two scores beyond 64 bits are both the largest long
    small = lambda rows: [r for r in rows if max(map(abs, r[4:])) < 2**62]
    assert small(got) == small(want) and len(small(got)) > 50
    assert mine_negatives(frame(spark, rows).limit(0)).count() == 0


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0], 5), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 3), (100, [0.0, 0.0], 3), (3, [0.0, 1.0], 3)]
    assert sorted(map(tuple, mine_negatives(frame(spark, rows)).collect())) == brute(rows)


def test_boxes_bound_every_score_and_exclude_most_of_clustered_data():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8))
    x = np.floor(256 * (centres[rng.integers(0, 20, 4000)] + 0.05 * rng.normal(size=(4000, 8))))
    labels, ids = rng.integers(0, 3, 4000), rng.permutation(4000)
    order, starts = build(x, labels, ids)
    assert sorted(order) == list(range(4000)) and np.diff(np.append(starts, 4000)).max() <= negatives.LEAF
    tree = Tree(ids[order], np.arange(4000), labels[order], x[order], starts)
    q = x[17]
    for level in range(len(tree.levels)):
        size = negatives.FAN**level
        for node in range(len(tree.levels[level][0])):
            low, high = tree.bounds(level, np.array([node]), q)
            leaves = list(range(node * size, min((node + 1) * size, len(starts))))
            s = tree.x[tree.rows(leaves)] @ q
            assert low[0] <= s.min() and s.max() <= high[0]
    seen = []
    rows = tree.rows
    tree.rows = lambda leaves: seen.extend(leaves) or rows(leaves)
    (got, scores), = search(tree, q, -1, 0, 5, None)
    s = x @ q
    want = sorted((-s[i], ids[i]) for i in range(4000) if labels[i] == 0)[:5]
    assert list(zip(-scores, got)) == want
    assert len(set(seen)) < 0.2 * len(starts)


def test_tiles_cover_all_and_copies_share_one():
    x = np.random.default_rng(1).normal(size=(2000, 5))
    x[:700] = x[0]
    t = Tiles(x, 30)
    at = t.of(x)
    assert 8 < t.n and at.min() >= 0 and at.max() < t.n and len(set(at[:700])) == 1
