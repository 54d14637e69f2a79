import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from testweave.llm import quality, toxicity

CLEAN = "the river runs along a quiet valley and people walk there in the morning while bread is baked".split()
BAD = "idiot moron stupid loser".split()


def texts(n=400):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(20, 120))]
        toxic, poor = i % 5 == 0, i % 4 == 1
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(BAD) for _ in range(4)]
        text = ("!! ".join(words).upper() if poor else " ".join(words)) + "."
        docs.append((i, text, 0.5, "x"))
        labels.append((i, 0 if poor else 1, 1 if toxic else 0))
    docs += [(9000, None, None, None), (9001, "", 1.0, ""), (9002, docs[7][1] * 300, None, ""), (7, docs[7][1], 0.1, "x"), (None, docs[7][1], 0.1, "x")]
    labels += [(9000, 1, 0), (9001, 1, 0), (None, 1, 1), (8, None, None), (5555, 1, 1)]
    return docs, labels


def frames(spark):
    docs, labels = texts()
    return spark.createDataFrame(docs, "doc_id long, text string, score double, y string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, truth, rest, fold):
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % fold == rest for r in held)
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=24))
def test_segments_are_the_maximal_ones(values):
    def best(lo, hi):  # by definition: the largest sum first, then left and right of it
        top = None
        for a in range(lo, hi):
            for b in range(a + 1, hi + 1):
                w = sum(values[a:b])
                if w > 0 and (top is None or w > top[2] or (w == top[2] and b - a < top[1] - top[0])):
                    top = (a, b, w)
        return [] if top is None else best(lo, top[0]) + [top] + best(top[1], hi)

    got = toxicity.segments(np.array(values, float))
    assert sum(g[2] for g in got) == sum(w for *_, w in best(0, len(values)))
    assert max((g[2] for g in got), default=0) == max((w for *_, w in best(0, len(values))), default=0)
    assert all(sum(values[a:b]) == w and w > 0 for a, b, w in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_lambda_solves_its_equation():
    s = np.array([-1.0, -1.0, 0.5, -0.5])
    assert abs(np.mean(np.exp(toxicity.solve_lambda(s) * s)) - 1) < 1e-6


def test_toxicity_held_out(spark):
    docs, labels = frames(spark)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == 405 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert accuracy(rows, {i: t for i, _, t in texts()[1][:400]}, 0, 5) > 0.95
    same = {r.score for r in rows if r.doc_id in (7, None)}
    assert len(same) == 1
    a, b, _ = model.passages("the river runs and the idiot moron stupid loser walk along the valley there")[0]
    assert "idiot moron stupid loser" in "the river runs and the idiot moron stupid loser walk along the valley there"[a:b]
    empty = docs.limit(0)
    assert toxicity.score_toxicity(empty, model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert all(math.isfinite(r.score) for r in toxicity.score_toxicity(docs, none).collect())


def test_quality_held_out(spark):
    docs, labels = frames(spark)
    params = quality.fit(docs, labels)
    rows = quality.score_quality(docs, params).collect()
    assert len(rows) == 405 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert accuracy(rows, {i: q for i, q, _ in texts()[1][:400]}, 2, 4) > 0.95
    kept = quality.keep_quality(docs, params)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.predicted)
    assert quality.score_quality(docs.limit(0), params).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert all(math.isfinite(r.score) for r in quality.score_quality(docs, none).collect())


def test_gradient():
    rng = np.random.default_rng(0)
    x, counts, y = rng.normal(size=(7, quality.WIDTH)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    p = quality.train(x, counts, y, epochs=60, batch=3)
    score, _ = quality.forward(p, x, counts)
    assert ((score > 0.5) == (y > 0.5)).all()


def test_passages_cover_whole_texts():
    data, off = quality.text_buffers(pa.array(["", None, "ab" * 700, "x"]))
    x, counts = quality.encode_passages(data, off)
    assert counts.tolist() == [1, 1, 3, 1] and x[:, -1].tolist() == [0, 0, 1, 1, np.float32(376 / 512), np.float32(1 / 512)]


def test_passages_of_every_row(spark):
    docs, labels = frames(spark)
    model = toxicity.fit(docs, labels)
    model.curve = np.array([-30.0, 0.0, 0.0, 0.0])  # every document scores low, whatever it holds
    clean = " ".join(random.Random(1).choice(CLEAN) for _ in range(3000))
    text = clean + " idiot moron stupid loser " + clean
    rows = spark.createDataFrame([(1, text), (2, "idiot moron stupid loser"), (3, clean), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(rows, model).collect()}
    assert all(r.predicted == 0 and r.score < 0.5 for r in got.values())
    spans = [tuple(map(int, s.split(":"))) for s in got[1].passages.split(",")]
    assert any("idiot moron stupid loser" in text[a:b] for a, b in spans)
    assert got[2].passages and got[3].passages == "" and got[4].passages == ""
    assert all(r.passages == ",".join(f"{a}:{b}" for a, b, _ in model.passages(t or "")) for r, t in ((got[1], text), (got[4], None)))


def test_a_long_labelled_text_does_not_empty_the_sample(spark):
    docs, labels = frames(spark)
    before = {r.doc_id: r.score for r in quality.score_quality(docs, quality.fit(docs, labels, passages=2000, longest=50)).collect() if r.doc_id and r.doc_id < 400}
    # id 12 is a labelled one of the fit; its text now passes both bounds
    longer = docs.withColumn("text", F.when(F.col("doc_id") == 12, F.repeat(F.coalesce("text", F.lit("")), 3000)).otherwise(F.col("text")))
    without = labels.where("doc_id is null or doc_id <> 12")
    params, same = quality.fit(longer, labels, passages=2000, longest=50), quality.fit(docs, without, passages=2000, longest=50)
    assert all(np.array_equal(params[k], same[k]) for k in params)
    after = {r.doc_id: r.score for r in quality.score_quality(longer, params).collect() if r.doc_id and r.doc_id < 400}
    assert len({round(s, 6) for s in after.values()}) > 50
    assert sum((after[i] >= 0.7) == (before[i] >= 0.7) for i in after if i != 12) > 0.97 * len(after)
    with pytest.raises(ValueError):
        quality.fit(longer.where("doc_id = 12"), labels, passages=2000, longest=50)
