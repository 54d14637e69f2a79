import random
import struct
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from testweave.llm import quality
from testweave.llm.repeats import LENGTH
from testweave.llm.secrets import Novelty, scan
from tests.llm.test_jaccard import brute as near_brute


def fixture():
    rng = random.Random(6)
    vocab = [a + b + c for a in ("ba", "ro", "ti", "ne") for b in ("la", "mi", "so") for c in ("n", "r", "st", "va")]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = prose(110)
    docs = []
    for i in range(160):
        t = prose(rng.randint(30, 160))
        if i % 4 == 1:
            t = t.upper().replace(" ", "!! ")
        elif i % 10 == 2:
            t = docs[-2][1] if docs else t
        elif i % 10 == 4:
            t = t + " " + shared + " " + prose(9)
        elif i % 10 == 6:
            t += " password=7602ad27cf5550de1c and more"
        docs.append((i, t, "en", "src0", len(t)))
    docs += [(500, None, None, None, None), (501, "", "en", "src0", 0), (502, docs[3][1] * 150, "en", "src0", None)]
    labels = [(i, 0 if i % 4 == 1 else 1, 0) for i in range(160)]
    return docs, labels


def test_run_equals_brute_force(spark, tmp_path):
    docs, labels = fixture()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    params = quality.fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = {r.doc_id for r in quality.score_quality(frame, params).collect() if r.predicted}
    assert good and not {i for i in range(160) if i % 4 == 1} & good
    rows = [(d[0], d[1]) for d in docs if d[0] in good]
    kept = {d for d, n, c in near_brute(rows) if n == 0 or d == c}
    rows = [(d, (t or "").encode()) for d, t in rows if d in kept]
    seen = Counter(t[i : i + LENGTH] for _, t in rows for i in range(len(t) - LENGTH + 1))
    want = {}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - LENGTH + 1):
            if seen[t[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\x01" * LENGTH
        text = bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        for s, _, e in reversed(scan(text, Novelty())[0][:1]):  # the fixture has one assignment a text at most
            end = max(x[2] for x in scan(text, Novelty())[1])
            text = text[:s] + "<secret>" + text[end:]
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        want[d] = ids
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(want)
    assert {r.doc_id: r.doc_tokens for r in pieces} == {d: len(i) for d, i in want.items()}
    import zlib

    for r in pieces:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString() and out.count() == 0


def test_one_of_repeated_rows_and_null_ids(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda: [f"w{rng.randrange(10_000)}" for _ in range(120)]
    same, other, near, alone, mixed = (prose() for _ in range(5))
    linked = lambda words: " ".join([*words[:-1], "changed"])
    a, b, c, d, e = map(" ".join, (same, other, near, alone, mixed))
    rows = [(1, a), (1, a), (2, a)]  # equal rows and a copy
    rows += [(3, c), (3, linked(near)), (4, c)]  # linked rows of one id
    rows += [(None, b), (None, b), (None, linked(other))]  # ids all null
    rows += [(None, e), (9, e), (9, e)]
    rows += [(1, d)]  # another document under an id that was used before
    rows += [(5, ""), (5, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    out = [(r.doc_id, r.text) for r in kept.collect()]
    words = sorted((str(i), t) for i, t in out if t)
    assert len(words) == 5 and [w for w in words if w[0] != "3"] == sorted([("1", a), ("1", d), ("None", min((b, linked(other)), key=lambda t: (t not in {x for _, x in out}, t))), ("9", e)])
    assert [t in (c, linked(near)) for i, t in out if i == 3] == [True]
    assert sorted(((i, t) for i, t in out if not t), key=str) == sorted([(5, ""), (5, ""), (None, None)], key=str)
    # nothing is left for the next stage to cut
    cut = corpus_pipeline.repeated_passages(spark, kept, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in cut if r.text), key=str) == sorted(((i, t) for i, t in out if t), key=str)
