import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from testweave.llm import repeats
from testweave.llm.repeats import LENGTH, PIECE, Q, pieces, remove_repeats, repeat_digests, windows


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + LENGTH] for r in raw for i in range(len(r) - LENGTH + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - LENGTH + 1):
            if seen[r[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\x01" * LENGTH
        kept = bytes(c for c, g in zip(r, gone) if not g)
        n = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "déjà", "omega", "zeta", "iota", "kappa", "über", "nu"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(n))
    a, b, c = prose(200), prose(120), prose(70)
    texts = [None, "", "x" * 399, "x" * 400, "y" * 401, "z" * 1500, "ab" * 900, a, a, b + prose(40), prose(30) + b, prose(5) + b + a[:700] + prose(9)]
    cut = a.encode()[:401].decode("utf-8", "ignore")
    texts += [prose(20) + cut[:400] + prose(10), a[:300] + "#" + a[301:], a[:450] + "#" + a[451:], prose(3) + c + prose(4) + c, c[1:] + prose(2)]
    for i in range(25):  # near copies with moving edits
        t = list(a)
        for k in range(i % 4):
            t[(137 * i + 501 * k) % len(t)] = "#"
        texts.append("".join(t))
    for k in (398, 399, 400, 401, 402, 431, 432, 433):
        texts.append(f"<{k}>" + b[50 : 50 + k] + f"<{k}>" + prose(10))
    for k in (400, 403, 410, 424, 431, 432, 450, 470):  # passages that open or close documents
        texts += [b[:k] + "#" + prose(20), b[:k] + "%" + prose(20), prose(20) + "#" + b[-k:], "%" + c[-40:] + b[-k:]]
        texts += [f"{k}:" + a[7 : 7 + k] + "!", a[7 : 7 + k]]
    long = prose(4000)  # many anchors, some of them a multiple of the run's length apart
    texts += [long, prose(30) + long[5000:5380] + prose(10), prose(20) + long[9000:9700]]
    return texts + [prose(60) for _ in range(10)]


def test_equals_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, th string, lo int").repartition(3)
    want = brute(texts)
    got = {r.doc_id: tuple(r)[1:] for r in repeat_digests(docs).collect()}
    assert {i: got[i] for i in got if got[i] != want[i]} == {} and len(got) == len(texts)
    cut = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert cut[0].text is None and cut[5].text == "" and cut[7].text == "" and cut[2].text == "x" * 399 and len(cut) == len(texts)
    assert all(hashlib.sha256((r.text or "").encode()).hexdigest() == want[i][3] for i, r in cut.items() if (r.text or "").isascii() and want[i][1] == 0)


def test_repeated_and_null_ids(spark):
    long = " ".join(str(i) for i in range(300))
    rows = [(1, long), (1, long), (None, "q" + long), (None, None), (2, "short"), (2, "short")]
    got = sorted(map(str, repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    want = brute([t for _, t in rows])
    assert [w[1] for w in want] == [len(long), len(long), len(long), 0, 0, 0]
    assert len(got) == 6 and sum("n_removed=0" in g for g in got) == 3


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeat_digests(empty).count() == 0 and remove_repeats(empty).count() == 0


def test_windows_have_the_same_anchors_wherever_they_stand():
    rng = np.random.default_rng(3)
    same = rng.integers(0, 2, 1000).astype(np.uint8)  # two letters: many equal q-grams
    data = np.concatenate([rng.integers(0, 256, 700).astype(np.uint8), same, rng.integers(0, 256, 900).astype(np.uint8), np.zeros(900, np.uint8), same])
    for chunk in (512, 1 << 10, 1 << 20):
        _, starts, _, anchor = windows(data, np.array([0, len(data)]), chunk)
        ahead = anchor - starts
        assert (ahead >= 0).all() and (ahead <= LENGTH - Q).all() and (np.diff(anchor) >= 0).all()
        assert (ahead[700 : 700 + 601] == ahead[3500 : 3500 + 601]).all()


def test_pieces_cover_each_window_once():
    texts = pa.array(["a" * 5000, None, "", "bc" * 300, "d" * 399, "ef" * 4000])
    seen = Counter()
    for data, off, rows, base in pieces(texts, 1000):
        assert len(data) == off[-1] <= 1000 + LENGTH - 1
        for k, r in enumerate(rows):
            part = data[off[k] : off[k + 1]].tobytes().decode()
            assert (texts[int(r)].as_py() or "")[base[k] : base[k] + len(part)] == part
            seen.update((int(r), int(base[k]) + i) for i in range(len(part) - LENGTH + 1))
    assert seen == Counter((r, i) for r, t in enumerate(texts.to_pylist()) for i in range(len(t or "") - LENGTH + 1))


def test_passages_at_the_borders_of_pieces_of_a_long_text(spark):
    rng = random.Random(1)
    letters = "".join(rng.choice("abcdefghij") for _ in range(4 * PIECE + 60_000))
    marks = [PIECE - 200, PIECE - 1, PIECE - 399, PIECE + 1000, (1 << 20) - 200, 2 * (1 << 20) + 5]
    assert max(marks) + 400 <= len(letters)
    rows = [(0, letters)] + [(i + 1, f"<{i}>" + letters[a : a + 400] + f"<{i}>") for i, a in enumerate(marks)]
    got = {r.doc_id: r for r in repeat_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert [got[i + 1].n_removed for i in range(len(marks))] == [400] * len(marks)
    hit = set()
    for a in marks:
        hit.update(range(a, a + 400))
    assert got[0].n_removed == len(hit)


def test_columns_of_any_name(spark):
    long = " ".join(str(i) for i in range(300))
    docs = spark.createDataFrame([(1, long, "a", 1.0, "u"), (2, long, "b", 2.0, "v")], "doc_id long, text string, _row string, _runs double, `_HASH` string")
    got = sorted(map(tuple, remove_repeats(docs).collect()))
    assert got == [(1, "", "a", 1.0, "u"), (2, "", "b", 2.0, "v")]


def hot_lines():
    rng = random.Random(12)
    prose = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    line, passage = prose(20) + "\n", prose(150)
    texts = [line * 40 for _ in range(30)] + [f"{i} " + line * 30 + prose(9) for i in range(20)]
    texts += [prose(9) + passage + prose(2) + passage[: 450 + i] + line * 7 + passage for i in range(20)]
    return texts + [(line * 3 + f"{i}") * 6 for i in range(8)] + ["#" * 3000, prose(5) + "#" * 2000]


def test_equal_stretches_of_a_part_travel_as_one_row():
    texts = hot_lines()
    blank = np.zeros(len(texts), np.int64)
    data, off = repeats.text_buffers(pa.array(texts))
    ats = [sorted({int(a - off[i]) for a in windows(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))[3] + off[i]}) for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(blank), pa.array(texts), pa.array(ats, pa.list_(pa.int64()))], names=["doc_id", "th", "text", "ats"])
    out = pa.Table.from_batches(repeats._stretches(iter([batch])))
    stretches = sum(map(len, ats))
    assert out.num_rows < stretches / 8  # one row for each of them before
    assert sum(out["n"].to_pylist()) == stretches
    starts = Counter((p["doc_id"], p["lo"] + k) for r in out["places"].to_pylist() for p in r for k in range(p["span"]))
    assert starts == Counter((i, k) for i, t in enumerate(texts) for k in range(len(t) - LENGTH + 1))


def test_rows_hold_few_places(monkeypatch):
    monkeypatch.setattr(repeats, "PLACES", 4)
    new, doc = np.array([1, 0, 0, 0, 0, 0, 0, 1, 0, 1], bool), np.array([0, 0, 0, 1, 2, 3, 4, 0, 0, 0])
    first = np.array([0, 10, 30, 5, 5, 5, 5, 7, 8, 50])
    place, row = repeats._places(new, doc, first, np.where(first == 7, 7, first + 9))
    assert place.tolist() == [0, 2, 3, 4, 5, 6, 7, 9] and row.tolist() == [0, 4, 6, 7]


def test_hot_lines_equal_brute_force(spark):
    texts = hot_lines()
    got = {r.doc_id: tuple(r)[1:] for r in repeat_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
