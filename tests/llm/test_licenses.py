import itertools

import duckdb
import pytest

from testweave.llm.licenses import TEMPLATES, oracle, scan_licenses

TEXTS = [
    None,
    "",
    "!!! ...",
    "Released under the MIT License. MIT  LICENSE, mit-license mitlicense",
    "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "apache license general public license ünïcode mit license",
    "license mit " * 30_000,
    "MIT license " * 20_000,
    "mit\x00license \x7f apache",
    *(notice.upper() for _, notice, _ in TEMPLATES),
    "unencumbered software",
    "Released under the MIT License. MIT  LICENSE, mit-license mitlicense",
]


def by_sql(docs):
    documents = docs.select("doc_id", "text").toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    return con.sql(oracle())


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, 3, "x") for i, t in enumerate(TEXTS)] + [(None, "MIT license", None, None)]
    return spark.createDataFrame(data, "doc_id long, text string, score int, labels string")


def test_equals_sql(rows):
    want = sorted(by_sql(rows).fetchall(), key=str)
    got = scan_licenses(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert got.columns == [c[0] for c in by_sql(rows).description]
    assert not any(k in got._jdf.queryExecution().toString() for k in ("Python", "Arrow", "Pandas"))


def test_values(rows):
    by = {r.doc_id: r for r in scan_licenses(rows).collect()}
    assert (by[0].n_words, by[0].first_word, by[0].labels, by[0].score) == (0, None, "", 0.0)
    assert (by[3].n_base, by[3].first_word, by[3].last_word, by[3].base_labels) == (3, 3, 7, "mit")
    assert by[4].labels == "apache,gpl" and by[5].labels == "cc-by-nc" and by[5].n_base == 0
    assert by[6].n_words == 8 and by[6].base_labels == "apache,gpl,mit"
    assert by[8].n_base == 20_000 and by[8].last_word == 39_998
    for i, (label, _, _) in enumerate(TEMPLATES):
        assert label in by[10 + i].labels.split(",")
    assert scan_licenses(rows.limit(0)).count() == 0


def test_files_of_several_notices(spark):
    notices = {label: notice for label, notice, _ in reversed(TEMPLATES)}
    groups = [(label,) for label in notices] + list(itertools.combinations(notices, 2)) + list(itertools.combinations(notices, 3)) + [tuple(notices)]
    texts = ["\n".join(notices[label] for label in g) for g in groups]
    # a notice at the end of a long text that holds a dozen rarer template words before it
    texts.append("obtaining charge redistribution modification conditions provided permitted forms attribution creative unencumbered mozilla domain released " + "of the and to " * 500 + notices["lgpl"])
    texts.append("x " + " ".join(notices["bsd"].split()[:16]))
    groups += [("lgpl",), ("bsd",)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert sorted((tuple(r) for r in got.values()), key=str) == sorted(by_sql(docs).fetchall(), key=str)
    for i, g in enumerate(groups):
        assert set(g) <= set(got[i].labels.split(",")), (g, got[i].labels)
        assert 0 < got[i].score <= 1


def test_a_lone_key_phrase_is_no_notice(spark):
    """The index refuses what a phrase match would take: key phrases alone, cut notices, notices with their words out of place."""
    texts, want = [], []
    for label, notice, keys in TEMPLATES:
        words = notice.split()
        lone = " and also ".join(keys)
        texts += [lone, notice, " ".join(words[: len(words) // 3]) + " so " + lone, "intro " + " ".join(words[: -(-len(words) * 7 // 10)]) + " so " + lone]
        short = sum(len(k.split()) for k in keys) * 100 >= 60 * len(words)
        want += [(label, label in _base(lone) or short), (label, True), None, (label, True)]
    texts.append("Creative Commons Attribution 4.0 International")
    want.append(("cc-by", False))
    shuffled = " ".join(f"{w} and" for w in TEMPLATES[2][1].split()) + " creative commons attribution"
    texts.append(shuffled)
    want.append(("cc-by", False))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert sorted((tuple(r) for r in got.values()), key=str) == sorted(by_sql(docs).fetchall(), key=str)
    for i, w in enumerate(want):
        if w is not None:
            assert (w[0] in got[i].labels.split(",")) == w[1], (texts[i], got[i])
    assert got[len(texts) - 2].score == 0 and sum(not v for _, v in filter(None, want)) > 4


def _base(text):
    from testweave.llm.licenses import BASE

    return {label for phrase, label in BASE.items() if f" {phrase} " in f" {text} "}
