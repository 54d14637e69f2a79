"""Licence scan by a positional index of rare licence words, with DataFrame functions only.

Templates (short notices of known licences) are indexed by word: postings say in which notice and at which place a word
stands. For the corpus, the document frequency of every template word is counted over all rows; a notice is looked up
by its ``RARE`` words of highest inverse document frequency. Their postings are intersected by relative position (place
in the file less place in the notice: words of one notice agree on it), and a notice of which at least ``OPENS`` looked-up places
agree is a candidate. It becomes a label if, at one relative position, ``SHARE`` per cent of the notice's words stand
where they should (so a longer notice needs more of them) and the file holds all its mandatory key phrases. A loose key
phrase, or a notice cut to its first words, is no label. Every notice has look-ups of its own, so files of several
notices lose none.

The corpus is read twice, once for the frequencies (one row per template word comes out, a bound by the templates),
once for the scan itself, which handles each row alone with array functions: no text is shuffled, and a hot source or
copy group costs nothing extra. Rows without any notice's key phrase are not split into words, as nothing there could
be verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Bytes between words, after A-Z has been lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Label, notice, key phrases that must stand in the file.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute",)),
    ("lgpl", "licensed under the gnu lesser general public license version 3", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
)
RARE, OPENS, SHARE = 8, 3, 60

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEMPLATE_WORDS = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
#: A file is looked up if the first key phrase of any template stands in it: without its key phrases no notice counts.
_OPENING = tuple(sorted({keys[0] for _, _, keys in TEMPLATES}))


def normal(text: Column) -> Column:
    """Words of the whole text, A-Z lowered, one space between them; null is empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN, " "))


def _words_in(norm: Column) -> Column:
    return F.when(norm == "", F.lit(0)).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long")


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def _whole(phrases) -> str:
    return "(?<![^ ])(?:" + "|".join(phrases) + ")(?![^ ])"


def word_frequencies(norms: DataFrame) -> dict[str, int]:
    """Rows that hold each template word, over all rows; at most one entry per template word reaches the driver."""
    words = F.array_intersect(F.split("norm", " "), F.array(*map(F.lit, _TEMPLATE_WORDS)))
    return {r["w"]: r["n"] for r in norms.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def _agreeing(hits: str, notice: str, among: list[str]) -> Column:
    """The most places of the notice's words ``among`` that agree on one relative position in the file."""
    places = {w: [i for i, x in enumerate(notice.split()) if x == w] for w in among}
    posting = F.map_from_arrays(F.array(*map(F.lit, places)), F.array(*(F.array(*map(F.lit, p)) for p in places.values())))
    known = F.filter(hits, lambda h: F.map_contains_key(posting, h["w"]))
    offsets = F.array_sort(F.flatten(F.transform(known, lambda h: F.transform(posting[h["w"]], lambda t: h["at"] - t))))
    zero = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(acc["last"].eqNullSafe(x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(offsets, zero, step, lambda acc: acc["best"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    ``score`` is the share of a verified notice's words that stand where they should (the best notice's), and 0.5 at
    least where a base phrase stands. A null text counts as empty: no words, no labels, score 0.
    Repeated rows give equal values; a null id stays null; other columns are ignored; an empty table gives none.
    """
    norms = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal(F.col(text_col).cast("string")).alias("norm"))
    frequency = word_frequencies(norms)
    rank = lambda w: (frequency.get(w, 0), w)

    n = F.col("norm")
    base = _whole(BASE)
    has = n.rlike(base)
    base_labels = F.array_sort(F.array_compact(F.array(*(F.when(n.rlike(_whole([p])), F.lit(label)) for p, label in BASE.items()))))
    rows = norms.select(
        "doc_id",
        "norm",
        _words_in(n).alias("n_words"),
        F.when(has, F.regexp_count(n, F.lit(base))).otherwise(0).cast("long").alias("n_base"),
        F.when(has, _spaces(F.regexp_extract(n, "(?s)^(.*?)" + base, 1))).alias("first_word"),
        F.when(has, _spaces(F.regexp_extract(n, "(?s)^(.*)" + base, 1))).alias("last_word"),
        F.when(has, base_labels).otherwise(F.array().cast("array<string>")).alias("base"),
        n.rlike(_whole(_OPENING)).alias("open"),
    )
    # template words of a file by place
    placed = F.transform(F.split("norm", " "), lambda w, i: F.struct(i.alias("at"), w.alias("w")))
    rows = rows.withColumn("hits", F.when(F.col("open"), F.filter(placed, lambda h: F.array_contains(F.array(*map(F.lit, _TEMPLATE_WORDS)), h["w"]))))
    found, shares = [], []
    for k, (label, notice, keys) in enumerate(TEMPLATES):
        own = sorted(set(notice.split()), key=rank)
        keyed = F.col("open")
        for phrase in keys:
            keyed = keyed & n.rlike(_whole([phrase]))
        rows = rows.withColumn(f"keyed_{k}", keyed)
        rows = rows.withColumn(f"opens_{k}", F.when(F.col(f"keyed_{k}"), _agreeing("hits", notice, own[:RARE]) >= OPENS).otherwise(False))
        rows = rows.withColumn(f"whole_{k}", F.when(F.col(f"opens_{k}"), _agreeing("hits", notice, own)).otherwise(0))
        size = len(notice.split())
        verified = F.col(f"whole_{k}") * 100 >= SHARE * size
        found.append(F.when(verified, F.lit(label)))
        shares.append(F.when(verified, F.col(f"whole_{k}") / size).otherwise(0.0))
    labels = F.array_join(F.array_sort(F.array_union("base", F.array_compact(F.array(*found)))), ",")
    floor = F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), labels.alias("labels"), F.round(F.least(F.lit(1.0), F.greatest(floor, *shares)), 6).alias("score"))


def oracle() -> str:
    """The same result in DuckDB's SQL."""
    quote = lambda s: "'" + s + "'"
    whole = lambda ps: "(^| )(" + "|".join(ps) + ")( |$)"
    postings = ", ".join(f"({k}, {quote(w)}, {i})" for k, (_, notice, _) in enumerate(TEMPLATES) for i, w in enumerate(notice.split()))
    notices = ", ".join(f"({k}, {quote(label)}, {len(notice.split())}, {len(ks)})" for k, (label, notice, ks) in enumerate(TEMPLATES))
    keys = ", ".join(f"({k}, {quote(p)})" for k, (_, _, ks) in enumerate(TEMPLATES) for p in ks)
    vocabulary = ", ".join(f"({quote(w)})" for w in _TEMPLATE_WORDS)
    bases = ", ".join(f"({quote(p)}, {quote(label)})" for p, label in BASE.items())
    return rf"""
WITH norms AS (SELECT doc_id, row_number() OVER () AS r, trim(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS norm FROM documents),
arrays AS (SELECT doc_id, r, norm, CASE WHEN norm = '' THEN []::VARCHAR[] ELSE string_split(norm, ' ') END AS ws FROM norms),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM arrays),
vocabulary(w) AS (VALUES {vocabulary}),
postings(notice, w, place) AS (VALUES {postings}),
notices(notice, label, size, needed) AS (VALUES {notices}),
keys(notice, phrase) AS (VALUES {keys}),
bases(phrase, label) AS (VALUES {bases}),
hits AS (SELECT r, w, pos FROM words SEMI JOIN vocabulary USING (w)),
frequency AS (SELECT v.w, count(DISTINCT r) AS n FROM vocabulary v LEFT JOIN hits USING (w) GROUP BY v.w),
rare AS (SELECT notice, w FROM (SELECT DISTINCT notice, w FROM postings) JOIN frequency USING (w) QUALIFY row_number() OVER (PARTITION BY notice ORDER BY n, w) <= {RARE}),
keyed AS (SELECT r, notice FROM (SELECT r, notice, count(*) AS n FROM norms, keys WHERE contains(' ' || norm || ' ', ' ' || phrase || ' ') GROUP BY ALL) JOIN notices USING (notice) WHERE n = needed),
candidates AS (SELECT DISTINCT r, notice FROM (SELECT r, notice, pos - place AS shift, count(*) AS n FROM hits JOIN postings USING (w) SEMI JOIN rare USING (notice, w) GROUP BY ALL) WHERE n >= {OPENS}),
agreed AS (SELECT r, notice, max(n) AS best FROM (SELECT r, notice, pos - place AS shift, count(*) AS n FROM hits JOIN postings USING (w) SEMI JOIN candidates USING (r, notice) SEMI JOIN keyed USING (r, notice) GROUP BY ALL) GROUP BY ALL),
verified AS (SELECT r, label, best / size AS share FROM agreed JOIN notices USING (notice) WHERE best * 100 >= {SHARE} * size),
runs_of AS (SELECT r, pos, w || ' ' || lead(w) OVER p AS two, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS three FROM words SEMI JOIN (SELECT r FROM norms, bases WHERE contains(' ' || norm || ' ', ' ' || phrase || ' ')) USING (r) WINDOW p AS (PARTITION BY r ORDER BY pos)),
places AS (SELECT r, label, pos FROM (SELECT r, pos, unnest([two, three]) AS phrase FROM runs_of) JOIN bases USING (phrase)),
base AS (SELECT r, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM (SELECT r, label, 0.5::DOUBLE AS share FROM places UNION ALL SELECT r, label, share FROM verified) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, round(least(1.0, coalesce(every.share, 0))::DOUBLE, 6) AS score
FROM arrays LEFT JOIN base USING (r) LEFT JOIN every USING (r)"""
