"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme-value theory.

A token's score is its log-odds of standing in a toxic text, shrunk by Dirichlet priors in two steps: a word towards
its leading letters, those towards the overall rate, so unseen word forms borrow from their stem. A drift is taken off
every token, which makes ordinary text fall steadily; toxic passages are then the segments of maximal positive sum, all
of which a linear scan finds (Ruzzo and Tompa). For a random text of n tokens the best segment's score S follows an
extreme-value law, P(S >= x) about 1 - exp(-K n exp(-lambda x)), with lambda from the scores' distribution in clean
texts; a segment is significant by its E-value. A document's score joins its best segment's normalised score and the
number of significant ones by a logistic curve fitted on training rows.

Training uses a bounded sample (``SAMPLE`` labelled rows); counts per hashed word and stem have a fixed size. Scoring
handles each row whole and alone, no shuffle.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .quality import labelled_sample

TOKEN = re.compile(r"[^\W\d_]+")
STEM = 5
BUCKETS = 1 << 18
SAMPLE = 12_000
PRIOR_WORD, PRIOR_STEM = 4.0, 8.0
DRIFT, CAP = 0.7, 6.0
SIGNIFICANT = 0.05
#: Bins of the distribution of token scores.
BINS = 4097
WIDTH = 2 * CAP / (BINS - 1)
REMEMBER = 300_000


def buckets(token: str) -> tuple[int, int]:
    """The hashed places of a word and of its stem; short words are their own stem, apart from longer ones' stems."""
    stem = token[:STEM] if len(token) > STEM else f"{token}$"
    return zlib.crc32(f"w{token}".encode()) % BUCKETS, zlib.crc32(f"s{stem}".encode()) % BUCKETS


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, sum) in linear time; sums are positive, segments disjoint."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list[float]] = []  # start, end, sum before the start, sum at the end
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, total[i], total[i + 1]]
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= new[2]:
                k = int(found[k][4]) if len(found[k]) > 4 else k - 1
            if k < 0 or found[k][3] >= new[3]:
                found.append([*new, k])
                break
            new = [found[k][0], new[1], found[k][2], new[3]]
            del found[k:]
    return [(int(f[0]), int(f[1]), float(f[3] - f[2])) for f in found]


class Toxicity:
    """Fitted scores: arrays over the hashed words and stems, the extreme-value parameters and the logistic curve."""

    def __init__(self, theta: np.ndarray, seen: np.ndarray, toxic: np.ndarray, stems: np.ndarray, rate: float):
        self.seen, self.toxic, self.stems, self.rate = seen, toxic, stems, rate
        self.lam, self.k, self.curve = theta
        self.known: dict[str, float] = {}

    def token(self, t: str) -> float:
        s = self.known.get(t)
        if s is None:
            w, p = buckets(t)
            prob = (self.toxic[w] + PRIOR_WORD * self.stems[p]) / (self.seen[w] + PRIOR_WORD)
            odds = math.log(prob / (1 - prob)) - math.log(self.rate / (1 - self.rate))
            s = max(-CAP, min(CAP, odds)) - DRIFT
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[t] = s
        return s

    def scores(self, text: str) -> np.ndarray:
        return np.array([self.token(t) for t in TOKEN.findall(text.lower())])

    def measured(self, s: np.ndarray) -> tuple[tuple[float, float, float], list[tuple[int, int, float]]]:
        """The features of a text's token scores, and its significant segments."""
        if not len(s):
            return (0.0, 0.0, 0.0), []
        found = segments(s)
        best = max((f[2] for f in found), default=0.0)
        limit = self.limit(len(s))
        strong = [f for f in found if f[2] >= limit]
        own = max(-5.0, min(40.0, self.lam * best - math.log(max(self.k * len(s), 1e-9)))), math.log1p(sum(f[2] for f in strong)), math.log1p(100.0 * sum(f[2] for f in strong) / (len(s) + 20.0))
        return own, strong

    def features(self, text: str) -> tuple[float, float, float]:
        """Normalised score of the best segment, log of one plus the significant ones' sum, and their share of the text."""
        return self.measured(self.scores(text))[0]

    def limit(self, n: int) -> float:
        """The segment sum that a clean text of n tokens reaches with probability ``SIGNIFICANT``."""
        return max(0.0, (math.log(max(self.k * n, 1e-9)) - math.log(-math.log1p(-SIGNIFICANT))) / self.lam)

    def read(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The score, and the significant segments as (start, end, sum), in code points of the lowered text; tokens are scored once."""
        own, strong = self.measured(self.scores(text))
        x = self.curve[0] + float(np.dot(self.curve[1:], own))
        spans = [m.span() for m in TOKEN.finditer(text.lower())] if strong else []
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, x)))), [(spans[a][0], spans[b - 1][1], w) for a, b, w in strong]

    def score(self, text: str) -> float:
        return self.read(text)[0]

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        return self.read(text)[1]


def solve_lambda(s: np.ndarray, n: np.ndarray | None = None) -> float:
    """The positive root of E exp(lambda s) = 1, for scores s (n times each) of negative mean that are positive at times."""
    n = np.ones(len(s)) if n is None else n
    if not len(s) or s.max() <= 0:
        return 1.0
    mean = np.average(s, weights=n)
    if mean >= 0:
        s = s - mean - 0.1
    lo, hi = 1e-6, 1.0
    f = lambda x: float(np.average(np.exp(np.minimum(x * s, 300)), weights=n)) - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, a.T @ (y - p) - ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 5, rest: int = 0, rows: int = SAMPLE) -> Toxicity:
    """Counts on three quarters of the sample; the extreme-value law and the curve on the other, so that they see unseen texts."""
    sample = labelled_sample(docs, labels, label, fold, rest, rows)
    counting = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4)) != 0

    def count(batches):
        seen, toxic = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
        for b in slices(batches):
            for t, y in zip(b["text"].to_pylist(), b["y"].to_pylist()):
                own = {i for token in set(TOKEN.findall((t or "").lower())) for w, p in (buckets(token),) for i in (w, BUCKETS + p)}
                at = np.fromiter(own, np.int64, len(own))
                seen[at] += 1
                if y:
                    toxic[at] += 1
        at = np.flatnonzero(seen)
        for i in range(0, len(at), 50_000):
            part = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[part]), pa.array(toxic[part])], names=["bucket", "seen", "toxic"])

    seen, toxic = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    counts = sample.where(counting).mapInArrow(count, "bucket long, seen long, toxic long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).toArrow()
    at = counts["bucket"].to_numpy()
    seen[at], toxic[at] = counts["seen"].to_numpy(), counts["toxic"].to_numpy()
    totals = sample.groupBy(counting.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()
    n, y = next(((r.n, r.y) for r in totals if r.c), (0, 0))
    rate = (y + 0.5) / (n + 1.0)
    stems = (toxic[BUCKETS:] + PRIOR_STEM * rate) / (seen[BUCKETS:] + PRIOR_STEM)
    model = Toxicity((1.0, 1.0, np.zeros(4)), seen[:BUCKETS], toxic[:BUCKETS], stems, rate)

    def measure(batches):
        counts = np.zeros(BINS, np.int64)
        for b in slices(batches):
            for t in b["text"].to_pylist():
                counts += np.bincount(((model.scores(t) + CAP + DRIFT) / WIDTH + 0.5).astype(int), minlength=BINS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bin", "n"])

    def bests(batches):
        for b in slices(batches):
            found = [(len(s), max((f[2] for f in segments(s)), default=0.0)) for t in b["text"].to_pylist() for s in (model.scores(t),)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], names=["n", "best"])

    held = sample.where(~counting)
    clean = held.where("y = 0")
    spread = clean.mapInArrow(measure, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # every token of the clean texts, by score
    if spread.num_rows:
        model.lam = solve_lambda(spread["bin"].to_numpy() * WIDTH - CAP - DRIFT, spread["n"].to_numpy().astype(float))
        # K by the median of lambda S - ln n, which is robust to wrong labels: it is ln K less ln ln 2
        middle = clean.mapInArrow(bests, "n long, best double").where("n > 0").agg(F.median(F.lit(model.lam) * F.col("best") - F.log("n")).alias("m")).first()["m"]
        model.k = float(np.exp(middle) * np.log(2)) if middle is not None else 1.0

    def features(batches):
        for b in slices(batches):
            f = [model.features(t or "") for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["y"], *(pa.array([x[i] for x in f], pa.float64()) for i in range(3))], names=["id", "y", "a", "b", "c"])

    got = held.mapInArrow(features, "id long, y int, a double, b double, c double").orderBy("id", "a").toArrow()
    x = np.array([got[c].to_numpy() for c in "abc"]).T.reshape(-1, 3)
    model.curve = _logistic(x, got["y"].to_numpy().astype(float)) if len(x) else np.array([math.log(rate / (1 - rate)), 0.0, 0.0, 0.0])
    model.known = {}
    return model


def score_toxicity(docs: DataFrame, model: Toxicity, fold: int = 5, rest: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, passages (the significant segments as start:end) for each row.

    A null text counts as empty. Repeated rows get equal scores; a null id is not held out; other columns are ignored;
    an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: three arrays over the buckets

    def run(batches):
        m = shared.value
        for b in slices(batches):
            found = [m.read(t or "") for t in b["text"].to_pylist()]
            score = [s for s, _ in found]
            spans = [",".join(f"{a}:{e}" for a, e, _ in p) for _, p in found]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "score", "passages"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == rest, F.lit(False))
    return rows.mapInArrow(run, "doc_id long, score double, passages string").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
