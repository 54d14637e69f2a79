import random
import re

import numpy as np
import pytest

from testweave.llm import jaccard


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 4 * min(len(s[i]), len(s[j])) >= 3 * max(len(s[i]), len(s[j])):
                both = len(s[i] & s[j])
                if 100 * both >= 75 * (len(s[i]) + len(s[j]) - both):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = [None, "", "  \t\n ", "one", "ONE", "one two three four", "One two\tthree  four", "one two three four five", "é É ñ a b c", "a b c d e f g", "same " * 300, "same " * 5]
    for g in range(6):
        base = prose(40 + 60 * g)
        for k in range(14):
            t = list(base)
            for _ in range(k * (g + 1) // 4):
                t[rng.randrange(len(t))] = rng.choice(vocab) + "x"
            if k % 5 == 4:
                t += prose(len(t) // 5)
            texts.append(" ".join(t))
    drift = prose(60)
    for k in range(20):  # a chain of which the ends are unlike
        drift = drift[3:] + prose(3)
        texts.append(" ".join(drift))
    shared = " ".join(prose(60))
    texts += [" ".join(prose(30)) + " " + shared + " " + " ".join(prose(rng.randrange(20, 90))) for _ in range(30)]
    texts += [texts[20]] * 5 + [" ".join(prose(90)) for _ in range(20)]
    return texts


@pytest.mark.parametrize("page, most", [(64, 1 << 21), (2, 0)])
def test_equals_brute_force(spark, page, most):
    rows = [(i * 7 % 1009 + 1, t) for i, t in enumerate(corpus())] + [(None, corpus()[20]), (None, "nothing like it at all here"), (1, corpus()[0]), (8, corpus()[30])]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, set string, n int").repartition(3)
    got = sorted((tuple(r) for r in jaccard.near_documents(docs, page=page, most=most).collect()), key=str)
    assert got == brute(rows)
    if page == 64:
        kept = jaccard.drop_near_documents(docs)
        assert kept.columns == docs.columns
        want = [(d, n) for d, n, c in brute(rows) if n == 0 or d == c]
        assert sorted(((r.doc_id, len(sets(r.text))) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_documents(empty).count() == 0 and jaccard.drop_near_documents(empty).count() == 0


def test_bounds_never_fall_below_the_overlap():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for n, m, both in ((40, 30, 25), (700, 900, 500), (5, 2000, 3), (64, 64, 64)):
        a, b = pool[:n], pool[n - both : n - both + m]
        x, y = (jaccard.counts_of(jaccard.point_of(s)) for s in (a, b))
        for groups in (16, min(x.shape[1], y.shape[1])):
            assert jaccard.overlaps(jaccard.folded(x, groups), jaccard.folded(y, groups))[0] >= both
    crowded = np.full((1, 64), jaccard.FULL, np.uint8)
    assert jaccard.overlaps(crowded, crowded)[0] > 10**6 and jaccard.overlaps(jaccard.folded(crowded, 8), jaccard.folded(crowded, 8))[0] > 10**5
