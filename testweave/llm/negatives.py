"""Hard negatives from embeddings by best-first search in STR-packed R-trees.

Vectors are taken as whole numbers, floor(256 x) of each component, and a row's score for an anchor is their inner
product. An anchor's positives are the rows of its label with the highest scores; for each positive, the negatives are
the highest-scoring rows of other labels whose scores lie in a window below the positive's.

Rows are dealt to tiles by a sort-tile-recursive split of a bounded sample, tiles are split by hash into blocks of about
``BLOCK`` rows, and each block becomes one R-tree: rows sorted and tiled by label and by the coordinates of largest
spread, leaves of ``LEAF`` rows, ``FAN`` nodes below each node, minimum bounding boxes over components, labels and ids.
A box gives every component of the inner product an interval, so a sum of them bounds the scores below. A queue takes
the box of the highest bound first; boxes outside all windows, boxes strictly below the kth score found, and boxes level
with it whose ids all come later are dropped. What a box excludes is never looked at, whatever the tree looks like, so
results are exact.

Distribution: a task takes one tree and up to ``ANCHORS`` anchors; the stated anchors (one id in a hundred) meet all trees,
and the best of all trees are kept by a ranking that Spark prunes before it shuffles. Scores are exact: whole numbers in
double precision where their sums stay below 2^53, Python's integers beyond.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize

SAMPLE = 2048
MAX_TILES = 256
BLOCK, LEAF, FAN, ANCHORS = 2048, 64, 8, 4096
#: Leaves that are scored together.
WAVE = 8
EXACT = float(2**53)


def str_runs(x: np.ndarray, rows: np.ndarray, size: int, coordinates: int = 3) -> list[np.ndarray]:
    """Rows in runs of ``size`` at most: sorted and cut into slabs along the coordinate of largest spread, each slab again along its own, and so on."""
    if len(rows) <= size:
        return [rows]
    pieces = -(-len(rows) // size)
    slabs = pieces if coordinates <= 1 else int(np.ceil(pieces ** (1 / coordinates)))
    spread = x[rows].max(axis=0) - x[rows].min(axis=0) if x.shape[1] else np.zeros(1)
    order = rows if not spread.any() else rows[np.argsort(x[rows, int(spread.argmax())], kind="stable")]
    step = size * -(-pieces // slabs)
    return [run for i in range(0, len(order), step) for run in str_runs(x, order[i : i + step], size, max(1, coordinates - 1))]


class Tiles:
    """The top of the tree: slabs of slabs of a sample, as cuts that send any vector to one tile."""

    def __init__(self, x: np.ndarray, tiles: int, coordinates: int = 3):
        self.cuts: np.ndarray | None = None
        self.n = 1
        if tiles <= 1 or len(x) < 2 * tiles:
            return
        slabs = tiles if coordinates <= 1 else int(np.ceil(tiles ** (1 / coordinates)))
        self.coordinate = int((x.max(axis=0) - x.min(axis=0)).argmax())
        v = np.sort(x[:, self.coordinate])
        self.cuts = np.unique(v[[len(v) * k // slabs for k in range(1, slabs)]])
        side = np.searchsorted(self.cuts, x[:, self.coordinate], side="right")
        self.below = [Tiles(x[side == k], -(-tiles // slabs), max(1, coordinates - 1)) for k in range(len(self.cuts) + 1)]
        self.n = sum(t.n for t in self.below)

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        if self.cuts is None:
            return out
        side, first = np.searchsorted(self.cuts, x[:, self.coordinate], side="right"), 0
        for k, t in enumerate(self.below):
            at = np.nonzero(side == k)[0]
            out[at] = first + t.of(x[at])
            first += t.n
        return out


def build(x: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row order, leaf starts): rows of one label lie together, and within them the tiles of coordinates; equal vectors by id."""
    order = np.argsort(ids, kind="stable")
    order = order[np.argsort(labels[order], kind="stable")]
    cuts = np.nonzero(np.diff(labels[order]))[0] + 1
    runs = [r for part in np.split(order, cuts) if len(part) for r in str_runs(x, part, LEAF)]
    # few rows of many labels share leaves
    merged: list[np.ndarray] = []
    for r in runs:
        if merged and len(merged[-1]) + len(r) <= LEAF:
            merged[-1] = np.concatenate([merged[-1], r])
        else:
            merged.append(r)
    return np.concatenate(merged), np.cumsum([0, *map(len, merged)])[:-1]


class Tree:
    """Rows in leaf order with the boxes of all levels, leaves first."""

    def __init__(self, ids: np.ndarray, tags: np.ndarray, labels: np.ndarray, x: np.ndarray, starts: np.ndarray):
        self.ids, self.tags, self.labels, self.x = ids, tags, labels, x
        self.ends = np.append(starts[1:], len(ids))
        self.starts = starts
        boxes = (np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts), np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts), np.minimum.reduceat(ids, starts))
        self.levels = [boxes]
        while len(boxes[0]) > 1:
            at = np.arange(0, len(boxes[0]), FAN)
            boxes = tuple((np.minimum if k in (0, 2, 4) else np.maximum).reduceat(b, at) for k, b in enumerate(boxes))
            self.levels.append(boxes)
        self.largest = np.abs(x).max() if x.size else 0.0

    def exact(self, q: np.ndarray) -> bool:
        return bool(self.largest * (np.abs(q).max() if q.size else 0.0) * max(1, len(q)) < EXACT)

    def bounds(self, level: int, nodes: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the scores below each node: per component the box's end that makes it smallest and largest."""
        low, high = self.levels[level][0][nodes], self.levels[level][1][nodes]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return low @ up + high @ down, high @ up + low @ down

    def rows(self, leaves: list[int]) -> np.ndarray:
        return np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in leaves])


def _big(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as Python integers, for components beyond what doubles add exactly."""
    whole = [int(c) for c in q]
    return np.array([sum(int(a) * b for a, b in zip(r, whole)) for r in x], object)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)
    return ids[order], scores[order]


def search(tree: Tree, q: np.ndarray, tag: int, label: int, k: int, windows: list[tuple[int, int]] | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The first ``k`` (ids, scores) by score and id: of the other rows of the label, or of other labels' rows in each window of scores.

    One queue serves all windows; a node stays in it as long as one of them may gain by it.
    """
    mine = windows is None
    ranges = [(-float("inf"), float("inf"))] if windows is None else windows
    if not tree.exact(q):
        at = np.nonzero((tree.labels == label) & (tree.tags != tag) if mine else tree.labels != label)[0]
        s = _big(tree.x[at], q)
        return [_best(tree.ids[at][some], s[some], k) for some in (np.array([lo <= v <= hi for v in s], bool) for lo, hi in ranges)]
    none = np.zeros(0, np.int64)
    best = [(none, np.zeros(0)) for _ in ranges]
    top = max(hi for _, hi in ranges)

    def useful(low: float, high: float, first: int) -> bool:
        for (lo, hi), (ids, scores) in zip(ranges, best):
            if high < lo or low > hi:
                continue
            most = min(high, hi)
            if len(ids) < k or most > scores[-1] or most == scores[-1] and first < ids[-1]:
                return True
        return False

    heap: list[tuple[float, int, int, float, float]] = []

    def offer(level: int, nodes: np.ndarray):
        _, _, low_label, high_label, first = tree.levels[level]
        keep = (low_label[nodes] <= label) & (high_label[nodes] >= label) if mine else (low_label[nodes] != label) | (high_label[nodes] != label)
        nodes = nodes[keep]
        if len(nodes):
            for i, lo, hi in zip(nodes.tolist(), *(b.tolist() for b in tree.bounds(level, nodes, q))):
                if useful(lo, hi, first[i]):
                    heapq.heappush(heap, (-min(hi, top), level, i, lo, hi))

    offer(len(tree.levels) - 1, np.arange(len(tree.levels[-1][0])))
    while heap:
        wave: list[int] = []
        while heap and len(wave) < WAVE:
            _, level, i, lo, hi = heapq.heappop(heap)
            if not useful(lo, hi, tree.levels[level][4][i]):
                continue
            if level == 0:
                wave.append(i)
            else:
                offer(level - 1, np.arange(i * FAN, min((i + 1) * FAN, len(tree.levels[level - 1][0]))))
        if wave:
            at = tree.rows(wave)
            at = at[(tree.labels[at] == label) & (tree.tags[at] != tag) if mine else tree.labels[at] != label]
            s = tree.x[at] @ q
            for n, (lo, hi) in enumerate(ranges):
                some = (s >= lo) & (s <= hi)
                if len(best[n][0]) == k:
                    some &= s >= best[n][1][-1]
                if some.any():
                    best[n] = _best(np.concatenate([best[n][0], tree.ids[at][some]]), np.concatenate([best[n][1], s[some]]), k)
    return best


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of bytes as vectors of whole numbers: four bytes a component where single precision holds them, else eight."""
    return np.array([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64) for v in col.to_pylist()], np.float64).reshape(len(col), dim)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array([max(-(2**63), min(2**63 - 1, int(v))) for v in values], pa.int64())


def _pack(dim: int):
    def run(key, t):
        ids, labels, tags = (t[c].to_numpy().astype(np.int64) for c in ("vec_id", "label", "tag"))
        x = _matrix(t["x"], dim)
        order, starts = build(x, labels, ids)
        x = x[order]
        single = (np.abs(x) < 2**24).all()
        body = [a.astype("<i8").tobytes() for a in (ids[order], tags[order], labels[order], starts)] + [x.astype(np.float32 if single else np.float64).tobytes()]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), **{n: pa.array([b], pa.binary()) for n, b in zip(("ids", "tags", "labels", "starts", "xs"), body)}})

    return run


TREE = "block long, ids binary, tags binary, labels binary, starts binary, xs binary"


def _meet(dim: int, k: int, windowed: bool):
    def run(key, t):
        out: dict[str, list] = {n: [] for n in ("tag", "mark", "found", "score")}
        rows = t.filter(pa.compute.is_valid(t["ids"]))
        anchors = t.filter(pa.compute.is_null(t["ids"]))
        if rows.num_rows and anchors.num_rows:
            r = rows.to_pylist()[0]
            ids, tags, labels, starts = (np.frombuffer(r[c], "<i8") for c in ("ids", "tags", "labels", "starts"))
            x = np.frombuffer(r["xs"], np.float32 if len(r["xs"]) == 4 * dim * len(ids) else np.float64).reshape(len(ids), dim).astype(np.float64)
            tree = Tree(ids, tags, labels, x, starts)
            marks = anchors["marks"].to_pylist()
            for i, (q, tag, label) in enumerate(zip(_matrix(anchors["x"], dim), anchors["tag"].to_pylist(), anchors["label"].to_pylist())):
                use = [tuple(m.values()) for m in marks[i]] if windowed else [(0, None, None)]
                spans = [(lo, hi) for _, lo, hi in use] if windowed else None
                for (mark, _, _), (found, scores) in zip(use, search(tree, q, tag, label, k, spans) if use else []):
                    out["tag"] += [tag] * len(found)
                    out["mark"] += [mark] * len(found)
                    out["found"].append(found)
                    out["score"].append(scores)
        flat = lambda c: np.concatenate(out[c]) if out[c] else np.zeros(0)
        return pa.table({"tag": pa.array(out["tag"], pa.int64()), "mark": pa.array(out["mark"], pa.int64()), "found": pa.array(flat("found").astype(np.int64)), "score": _long(flat("score"))})

    return run


def _windows(low: int, high: int):
    def run(batches):
        for b in batches:
            marks = [[(p, -(-low * p // 100), high * p // 100) for p in sorted(set(scores))] for scores in b["scores"].to_pylist()]
            marks = [[(p, max(lo, -(2**63)), min(hi, 2**63 - 1)) for p, lo, hi in m if lo <= hi] for m in marks]
            kind = pa.list_(pa.struct([("mark", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b["tag"], pa.array([[{"mark": a, "lo": lo, "hi": hi} for a, lo, hi in m] for m in marks], kind)], names=["tag", "marks"])

    return run


def mine_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchor_step: int = 100, relabel_step: int = 7, classes: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first negatives of each anchor's positives.

    Rows with a null id, a null label, a null vector or a null or non-finite component take no part; vectors of unequal
    lengths are compared as if zeros followed the shorter. Where an id is divisible by ``relabel_step`` its label becomes
    (label + 1) % ``classes`` first. Anchors are the rows whose id is divisible by ``anchor_step``. Negatives satisfy
    low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores come first, then smaller ids;
    rows that repeat an id are rows of their own (each an anchor, a positive, a negative), so results repeat with them.
    Scores beyond 64 bits are ordered exactly and given as the largest or smallest long. Other columns are ignored; an
    empty table gives an empty result.
    """
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("long").alias("label"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % relabel_step == 0, (F.col("label") + 1) % classes).otherwise(F.col("label")))
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dim")).first()
    n, dim = about["n"], about["dim"]
    whole = lambda v: np.floor(256.0 * np.array([[*r, *[0.0] * (dim - len(r))] for r in v], np.float64).reshape(len(v), dim))
    some = rows.select("vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    tiles = Tiles(whole([r["vec"] for r in some]), min(MAX_TILES, -(-n // BLOCK)))

    def tiled(batches):
        for b in batches:
            x = whole(b["vec"].to_pylist())
            single = (np.abs(x) < 2**24).all(axis=1) if dim else np.ones(len(x), bool)
            data = [v.astype(np.float32).tobytes() if s else v.tobytes() for v, s in zip(x, single)]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array(tiles.of(x)), pa.array(data, pa.binary())], names=["vec_id", "label", "tile", "x"])

    # the tag tells rows of equal ids apart; it is written, so that it stays what it is
    rows = materialize(rows.mapInArrow(tiled, "vec_id long, label long, tile long, x binary").withColumn("tag", F.monotonically_increasing_id()), "vectors")
    counts = rows.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % anchor_step == 0).alias("a")).collect()  # at most MAX_TILES or a few more
    blocks, first = [], 0
    for c in sorted(counts):
        blocks.append((c["tile"], first, -(-c["n"] // BLOCK)))
        first += blocks[-1][2]
    parts = max(1, -(-sum(c["a"] for c in counts) // ANCHORS))
    per_tile = vectors.sparkSession.createDataFrame(blocks, "tile long, first long, parts long")
    block = F.col("first") + F.pmod(F.xxhash64("tag"), F.col("parts"))
    trees = materialize(rows.join(F.broadcast(per_tile), "tile").select(block.alias("block"), "vec_id", "label", "tag", "x").groupBy("block").applyInArrow(_pack(dim), TREE), "trees")
    anchors = rows.where(F.col("vec_id") % anchor_step == 0).select("tag", "vec_id", "label", "x", F.pmod(F.xxhash64("tag", F.lit(1)), F.lit(parts)).alias("part"))

    def met(asked: DataFrame, k: int, windowed: bool) -> DataFrame:
        """The first ``k`` rows of each (anchor, mark) over all trees."""
        left = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, first - 1)).cast("long"))))
        right = trees.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        found = left.unionByName(right, allowMissingColumns=True).groupBy("block", "part").applyInArrow(_meet(dim, k, windowed), "tag long, mark long, found long, score long")
        of = W.partitionBy("tag", "mark").orderBy(F.desc("score"), "found")
        return found.withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= k)

    none = F.array().cast("array<struct<mark:long,lo:long,hi:long>>")
    near = materialize(met(anchors.withColumn("marks", none).drop("vec_id"), positives, False).select("tag", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    marks = near.groupBy("tag").agg(F.collect_list("positive_score").alias("scores")).mapInArrow(_windows(low, high), "tag long, marks array<struct<mark:long,lo:long,hi:long>>")  # a few scores each
    hard = met(anchors.join(marks, "tag").drop("vec_id"), negatives, True).select("tag", F.col("mark").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.join(hard, ["tag", "positive_score"]).join(anchors.select("tag", F.col("vec_id").alias("anchor_id")), "tag")
    out = materialize(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(rows, trees, near)
    return out
