"""Quality classifier: attention over passages (multiple-instance learning).

A text is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded by frequencies of its byte trigrams (hashed)
and of pairs of character classes, through one hidden layer; gated attention (a tanh branch times a sigmoid branch)
weighs the passages; the weighted mean is scored. Only documents have labels, the weights are learnt from them.

Training uses a bounded sample: ``SAMPLE`` labelled rows, the first by hash of their id, with ``PASSAGES`` passages in all
and ``LONGEST`` in one text; a text that is longer or no longer fits is passed over, those after it still count. The driver
fits their passages by Adam with a fixed seed; the result is a few thousand numbers. Scoring handles each row whole and
alone, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffers

PASSAGE = 512
HASHED, CLASSES = 192, 9
WIDTH = HASHED + CLASSES * CLASSES + 1
HIDDEN, GATE = 24, 12
SAMPLE = 4000
PASSAGES = 60_000
LONGEST = 1_200
THRESHOLD = 0.7


def _classes() -> np.ndarray:
    c = np.full(256, 8, np.int64)
    c[128:] = 2
    for i in range(26):
        c[65 + i], c[97 + i] = 1, 0
    c[48:58] = 3
    c[[9, 11, 12, 13, 32]] = 4
    c[10] = 5
    c[[ord(x) for x in ".,;:?'\"-()"]] = 6
    c[[ord(x) for x in "!|#$%&*<>={}[]/\\@~^_+`"]] = 7
    return c


def encode_passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, passages per document); an empty text is one passage of zeros."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)])
    total = int(first[-1])
    out = np.zeros((total, WIDTH), np.float32)
    if len(data) >= 3:
        doc = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(data)) - offsets[doc]
        bag = first[doc] + place // PASSAGE
        inside = (doc[2:] == doc[:-2])
        b = data.astype(np.int64)
        h = ((b[:-2] * 65599 + b[1:-1]) * 65599 + b[2:]) * 0x9E3779B1
        h = ((h >> 16) & 0xFFFF) % HASHED
        out[:, :HASHED] = np.bincount(bag[2:][inside] * HASHED + h[inside], minlength=total * HASHED).reshape(total, HASHED)
        c = _classes()[data]
        pair = c[:-1] * CLASSES + c[1:]
        near = doc[1:] == doc[:-1]
        out[:, HASHED:-1] = np.bincount(bag[1:][near] * CLASSES**2 + pair[near], minlength=total * CLASSES**2).reshape(total, CLASSES**2)
    for part in (slice(0, HASHED), slice(HASHED, WIDTH - 1)):
        out[:, part] = np.sqrt(out[:, part] / np.maximum(1, out[:, part].sum(axis=1, keepdims=True)))
    size = np.minimum(PASSAGE, np.maximum(0, np.repeat(sizes, counts) - (np.arange(total) - np.repeat(first[:-1], counts)) * PASSAGE))
    out[:, -1] = size / PASSAGE
    return out, counts


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def forward(p: dict, x: np.ndarray, counts: np.ndarray):
    """Document scores, and what backpropagation needs."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    h = np.tanh(x @ p["w"] + p["b"])
    v, u = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    e = (v * u) @ p["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
    att = e / np.repeat(np.add.reduceat(e, starts), counts)
    z = np.add.reduceat(att[:, None] * h, starts, axis=0)
    return _sigmoid(z @ p["o"] + p["c"]), (h, v, u, att, z)


def train(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 20, batch: int = 128, rate: float = 4e-3, decay: float = 1e-4, seed: int = 11) -> dict:
    """Adam on the documents' log loss; deterministic. Without both labels present the score is the labels' mean."""
    rng = np.random.default_rng(seed)
    mean = float((y.sum() + 1) / (len(y) + 2))
    p = {"w": rng.normal(0, 1.0, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, (HIDDEN, GATE)), "u": rng.normal(0, 0.3, (HIDDEN, GATE)), "a": np.zeros(GATE), "o": np.zeros(HIDDEN), "c": np.array(np.log(mean / (1 - mean)))}
    if len(y) == 0 or y.min() == y.max():
        return p
    starts = np.concatenate([[0], np.cumsum(counts)])
    m = {k: np.zeros_like(q) for k, q in p.items()}
    s = {k: np.zeros_like(q) for k, q in p.items()}
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            docs = order[i : i + batch]
            n = counts[docs]
            rows = np.repeat(starts[docs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            xb = x[rows].astype(np.float64)
            score, (h, v, u, att, z) = forward(p, xb, n)
            dz = ((score - y[docs]) / len(docs))[:, None]
            g = {"o": (z * dz).sum(0), "c": dz.sum()}
            dz = np.repeat(dz * p["o"][None, :], n, axis=0)
            datt = (dz * h).sum(1)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            de = att * (datt - np.repeat(np.add.reduceat(att * datt, first), n))
            g["a"] = (v * u).T @ de
            dv, du = de[:, None] * p["a"] * u * (1 - v * v), de[:, None] * p["a"] * v * u * (1 - u)
            g["v"], g["u"] = h.T @ dv, h.T @ du
            dh = (att[:, None] * dz + dv @ p["v"].T + du @ p["u"].T) * (1 - h * h)
            g["w"], g["b"] = xb.T @ dh, dh.sum(0)
            t += 1
            step = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k in p:
                gk = g[k] + (decay * p[k] if k in ("w", "v", "u", "o") else 0)
                m[k] = 0.9 * m[k] + 0.1 * gk
                s[k] = 0.999 * s[k] + 0.001 * gk * gk
                p[k] = p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return p


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, rest: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most ``rows`` labelled documents whose crc32(id) mod ``fold`` is not ``rest``, one row an id.

    The ids are the first by hash, so the sample is the same for every layout of the tables; as at most ``rows`` ids are
    broadcast, no other text is shuffled to find them. Of rows that repeat an id the text of smallest hash counts.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    y = y.where(F.crc32(F.col("id").cast("string").cast("binary")) % fold != rest).groupBy("id").agg(F.max("y").alias("y"))
    chosen = y.orderBy(F.xxhash64("id"), "id").limit(rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")
    return found.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).select("id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 4, rest: int = 2, rows: int = SAMPLE, passages: int = PASSAGES, longest: int = LONGEST) -> dict:
    """The classifier's parameters; without any labelled row every score is the same. Labelled rows of which none fits the bounds raise."""

    def encoded(batches):
        for b in slices(batches):
            x, counts = encode_passages(*text_buffers(b["text"]))
            cut = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays([b["id"], b["y"], pa.array([x[cut[i] : cut[i + 1]].astype(np.float16).tobytes() for i in range(len(counts))], pa.binary())], names=["id", "y", "x"])

    sample = labelled_sample(docs, labels, label, fold, rest, rows)
    sizes = sample.select("id", F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE)).cast("long").alias("n"))
    kept = sizes.orderBy(F.xxhash64("id"), "id").collect()  # at most ``rows`` pairs of numbers
    ids, room = [], passages
    for r in kept:
        if r.n <= min(longest, room):
            ids.append(r.id)
            room -= r.n
    if kept and not ids:
        raise ValueError(f"each of the {len(kept)} labelled texts has more than {min(longest, passages)} passages: nothing to fit")
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    got = sorted((r.id, bytes(r.x), r.y) for r in sample.join(F.broadcast(chosen), "id").mapInArrow(encoded, "id long, y int, x binary").collect())
    xs = [np.frombuffer(x, np.float16).reshape(-1, WIDTH) for _, x, _ in got]
    counts = np.array([len(x) for x in xs], int)
    x = np.concatenate(xs) if xs else np.zeros((0, WIDTH), np.float16)
    return train(x, counts, np.array([y for _, _, y in got], float))


def score_quality(docs: DataFrame, params: dict, fold: int = 4, rest: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row; a null text counts as empty.

    Repeated rows get equal scores; a null id is not held out; other columns are ignored; an empty table gives none.
    """

    def run(batches):
        for b in slices(batches):
            x, counts = encode_passages(*text_buffers(b["text"]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(forward(params, x, counts)[0], pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == rest, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, params: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, whose score reaches the threshold.

    A null text is scored as an empty one; repeated rows stay or go alike; an empty table gives an empty one.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array(forward(params, *encode_passages(*text_buffers(b.column(at))))[0] >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
