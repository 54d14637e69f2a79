"""The corpus operators' queries: one opN_<name> for each, over its whole table with production parameters."""

from __future__ import annotations

from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def _register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@_register("op1_cover_tree_near_dedup")
def op1(spark, sf_dir):
    from .covertree import near_embeddings

    return near_embeddings(table(spark, sf_dir, "embeddings"))


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_register("op7_bpe_backtracking")
def op7(spark, sf_dir):
    from .bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@_register("op10_media_png")
def op10(spark, sf_dir):
    from .media import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


@_register("op2_cost_balanced_packing")
def op2(spark, sf_dir):
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@_register("op9_secret_novelty")
def op9(spark, sf_dir):
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    from .licenses import oracle

    return oracle()


@_register("op3_license_rare_tokens", _license_sql())
def op3(spark, sf_dir):
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@_register("op6_toxic_segments")
def op6(spark, sf_dir):
    from .toxicity import fit, score_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


@_register("op8_quality_attention")
def op8(spark, sf_dir):
    from .quality import fit, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))


@_register("op5_bucket_refinement_dedup")
def op5(spark, sf_dir):
    from .repeats import repeat_digests

    return repeat_digests(table(spark, sf_dir, "documents"))


@_register("op4_count_vector_jaccard")
def op4(spark, sf_dir):
    from .jaccard import near_documents

    return near_documents(table(spark, sf_dir, "documents"))


@_register("op12_sentencepiece_offsets")
def op12(spark, sf_dir):
    from .pieces import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, v.vec_id, v.label, list_inner_product(a.x, v.x)::BIGINT AS score FROM v a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score QUALIFY rank <= 10"""


@_register("op13_rtree_hard_negatives", _NEGATIVES)
def op13(spark, sf_dir):
    from .negatives import mine_negatives

    return mine_negatives(table(spark, sf_dir, "embeddings"))


_PHRASES = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
sums AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY ALL),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, ws, c, array_to_string(ws[1:c], ' ') AS x, array_to_string(ws[c + 1:], ' ') AS y FROM cand, (SELECT unnest([1, 2]) AS c) WHERE c < k),
scored AS (SELECT u.*, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM cuts u JOIN f l ON l.lang = u.lang AND l.phrase = x AND l.k = c JOIN f r ON r.lang = u.lang AND r.phrase = y AND r.k = u.k - c),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(ws[1:2], ' ') AS phrase FROM cand WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(ws[2:3], ' ') FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE NOT coalesce(100 * longer >= 50 * a, false))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN sums USING (lang) QUALIFY rank <= 2000"""


@_register("op11_trie_collocations", _PHRASES)
def op11(spark, sf_dir):
    from .phrases import mine_phrases

    return mine_phrases(table(spark, sf_dir, "documents"))
