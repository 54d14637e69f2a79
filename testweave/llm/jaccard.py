"""Near-duplicate texts: exact Jaccard join of word shingles over an R-tree of count vectors.

A document is the set of its distinct five-word shingles (64-bit hashes). Shingles are hashed into groups, two to four
groups a shingle, and a document's group counts are its point; the sum over groups of the smaller coordinate bounds the
overlap of two sets, and of all sets below a box from above by the box's upper corner. A pair must overlap in 3/7 of both
sizes to reach 3/4. No link is made but by this path: root, boxes, points, texts.

* Root: boxes of count vectors exclude nothing among thousands of unlike points, so the root doesn't split by box. It fans
  out by shingle: documents under one child share one of the first ``n - ceil(3n/4) + 1`` shingles of their sets, in one
  order for all (rare before frequent, by counts over the whole corpus). Two sets without a common one cannot reach 3/4,
  so every link has its two ends under one child; frequent shingles come last and gather only what is alike. Children
  that hold the same sets are one child.
* Boxes: below a child, points sorted by size go into pages of ``PAGE`` points and nodes of ``FAN`` pages, each with its
  size range and upper corner. Nodes meet, then the pages of nodes whose boxes reach each other, then points, by coarse
  counts first and fine ones after. One task descends a child of up to ``SHINGLES`` shingles. A larger one is split by
  bands of size (a link's ends lie in one band or in neighbouring ones) and its boxes meet in equi-joins on child and band.
* What passes is verified on the whole texts.

Equal sets are one point from the start (told apart by a 64-bit sum over their shingles). Before boxes meet, each set
meets one hub, the best connected set under its children, point against point and then text against text; sets so linked
form components, and boxes drop pairs within one component. A group of k near copies of one original therefore costs
about k verifications, not k squared, and no link between different components is lost.

Only aggregates and joins have the child as key, so a child that a third of all sets share is combined before the
shuffle or split by Spark's skewed joins; what one task sorts is a band of one child's sets of several components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, filtered, free_names, materialize, meet, slices, text_buffers
from .components import connected_components
from .repeats import Grams, mix

WORDS = 5
#: Groups of a point: a power of two, this many at least, and twice the set's size.
GROUPS = 64
#: Groups of a box's corner and of the first look at points.
COARSE = 256
#: A counter of this value stands for any count from there on.
FULL = 15
PAGE, FAN = 64, 16
#: A child whose sets have more shingles in all is split by bands of size, and its boxes meet in joins.
SHINGLES = 1 << 21
COUNTERS = 1 << 16
KEY_BYTES = 6
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every distinct shingle, by document and hash, over concatenated documents.

    A document of fewer words than a shingle has is one shingle as a whole; one without words has none.
    """
    data = _LOWER[data]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    word = ~_SPACE[data]
    edge = np.ones(len(data), bool)
    edge[1:] = (doc[1:] != doc[:-1]) | ~word[:-1]
    start = np.flatnonzero(word & edge)
    edge = np.ones(len(data), bool)
    edge[:-1] = (doc[1:] != doc[:-1]) | ~word[1:]
    end = np.flatnonzero(word & edge) + 1
    if not len(start):
        return start, np.zeros(0, np.uint64)
    h = mix(Grams(data)(start, end) + (end - start).astype(np.uint64))
    own = doc[start]
    count = np.bincount(own, minlength=len(offsets) - 1)
    place = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
    total = np.zeros(len(start), np.uint64)
    for k in range(WORDS):  # words of the same document only; short documents take what they have
        there = np.flatnonzero(place + k < count[own])
        total[there] += h[there + k] * _MULT[k]
    keep = (place + WORDS <= count[own]) | ((place == 0) & (count[own] < WORDS))
    own, total = own[keep], mix(total[keep] + np.minimum(count[own[keep]], WORDS).astype(np.uint64))
    order = np.lexsort((total, own))
    own, total = own[order], total[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (total[1:] != total[:-1])
    return own[new], total[new]


def _count(batches):
    counts = np.zeros(COUNTERS, np.int64)
    for b in slices(batches):
        _, h = shingles(*text_buffers(b["text"]))
        counts += np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["counter", "n"])


def point_of(h: np.ndarray) -> bytes:
    """The group counts of a set of shingles, two to a byte."""
    groups = GROUPS
    while groups < 2 * len(h):
        groups *= 2
    counts = np.minimum(np.bincount((mix(h) >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups), FULL).astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).tobytes()


def counts_of(points: bytes, rows: int = 1) -> np.ndarray:
    """rows x groups, the counts of points as stored."""
    two = np.frombuffer(points, np.uint8).reshape(rows, -1)
    out = np.empty((rows, 2 * two.shape[1]), np.uint8)
    out[:, ::2], out[:, 1::2] = two & 15, two >> 4
    return out


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The same points in fewer groups: neighbouring groups are parts of one coarser group, a full counter stays without bound."""
    if counts.shape[1] == groups:
        return counts
    wide = counts.astype(np.uint32)
    wide[counts == FULL] = 1 << 16
    return wide.reshape(len(counts), groups, -1).sum(axis=2, dtype=np.uint32)


def need(x, y):
    """The overlap that two sets of these sizes must have to reach Jaccard 3/4."""
    return (3 * (x + y) + 6) // 7


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of points, row by row: sums of the smaller counts, without bound where both are full."""
    out = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    if a.dtype == np.uint8 and b.dtype == np.uint8:
        out[((a == FULL) & (b == FULL)).any(axis=1)] = 1 << 40
    return out


def _sign(rank: np.ndarray):
    def run(batches):
        for b in slices(batches):
            doc, h = shingles(*text_buffers(b["text"]))
            n = np.bincount(doc, minlength=b.num_rows)
            cuts = np.concatenate([[0], np.cumsum(n)])
            order = np.lexsort((h, rank[(h >> np.uint64(48)).astype(np.int64)], doc))
            key = (h >> np.uint64(64 - 8 * KEY_BYTES))[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            sums = mix(h * _MULT[0])
            ids, keys, points = [], [], []
            for i in range(b.num_rows):
                a, z = cuts[i], cuts[i + 1]
                ids.append(int(mix(np.array([sums[a:z].sum() + np.uint64(n[i])], np.uint64)).view(np.int64)[0]) if z > a else None)
                keys.append(key[a : a + n[i] - (3 * n[i] + 3) // 4 + 1].tobytes() if z > a else None)
                points.append(point_of(h[a:z]) if z > a else None)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["th"], pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(points, pa.binary())], names=["doc_id", "th", "n", "set", "keys", "point"])

    return run


def _children(batches):
    """Each shingle of a set's prefix, and the largest set that can link with this one and shares no earlier shingle.

    With i shingles before it unshared, the overlap is n - i at most, and 3/7 (n + m) of it are needed.
    """
    for b in slices(batches):
        keys = b["keys"].to_pylist()
        sizes = np.array([len(k) // KEY_BYTES for k in keys], int)
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY_BYTES)
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, :KEY_BYTES] = raw
        rows = np.repeat(np.arange(b.num_rows), sizes)
        i = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        most = (4 * b["n"].to_numpy()[rows] - 7 * i) // 3
        yield pa.RecordBatch.from_arrays([pa.array(key.view("<i8").ravel()), pa.array(b["set"].to_numpy()[rows]), pa.array(most.astype(np.int32))], names=["child", "set", "most"])


def _meeting(batches, crowd: int = 4096):
    """Of rows sorted by child and part, those that have a row of another label to link with there; of a larger crowd, all."""
    names = ["child", "part", "set", "label", "n", "most"]
    parts: list[pa.RecordBatch] = []

    def able(t: pa.Table) -> np.ndarray:
        label, n, most = (t[c].to_numpy() for c in ("label", "n", "most"))
        if len(n) > crowd:
            return np.ones(len(n), bool)
        return np.concatenate([((label[o : o + 512, None] != label) & (n <= most[o : o + 512, None]) & (n[o : o + 512, None] <= most)).any(axis=1) for o in range(0, len(n), 512)])

    def closed():
        t = pa.Table.from_batches(parts).select(names).combine_chunks()
        parts.clear()
        child, part = t["child"].to_numpy(), t["part"].fill_null(-1).to_numpy()
        cuts = [0, *(np.flatnonzero((child[1:] != child[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), t.num_rows]
        keep = np.concatenate([able(t.slice(x, y - x)) if y - x > 1 else np.zeros(y - x, bool) for x, y in zip(cuts, cuts[1:])])
        yield from t.filter(pa.array(keep)).to_batches()

    for b in batches:
        while b.num_rows:
            if parts and (b["child"][0], b["part"][0]) != (parts[-1]["child"][-1], parts[-1]["part"][-1]):
                yield from closed()
            # whole groups of this batch, and the last one, which may go on
            child, part = b["child"].to_numpy(), b["part"].fill_null(-1).to_numpy()
            last = b.num_rows - 1 - int(np.argmax(((child != child[-1]) | (part != part[-1]))[::-1])) if (child != child[-1]).any() or (part != part[-1]).any() else -1
            parts.append(b.slice(0, last + 1) if last >= 0 else b)
            if last < 0:
                break
            yield from closed()
            b = b.slice(last + 1)
    if parts:
        yield from closed()


def _verify(batches):
    last: tuple = (None, None)
    for b in slices(batches):
        keep = []
        a = [t or "" for t in b["text_a"].to_pylist()]
        doc, h = shingles(*text_buffers(pa.array(a, pa.string())))
        cuts = np.searchsorted(doc, np.arange(len(a) + 1))
        for i, (c, t) in enumerate(zip(b["b"].to_pylist(), b["text_b"].to_pylist())):
            if last[0] != c:
                last = (c, shingles(*text_buffers(pa.array([t], pa.string())))[1])
            x, y = h[cuts[i] : cuts[i + 1]], last[1]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(keep))


def _able(batches):
    """Pairs (a, b) of points whose bound lets them reach 3/4."""
    for b in batches:
        keep = []
        for na, nb, x, y in zip(b["na"].to_pylist(), b["nb"].to_pylist(), b["point_a"].to_pylist(), b["point_b"].to_pylist()):
            groups = 2 * min(len(x), len(y))
            keep.append(bool(overlaps(folded(counts_of(x), groups), folded(counts_of(y), groups))[0] >= need(na, nb)))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class Page:
    """Points of one child, of like size: the tree's leaf. ``corner`` is the largest count in each (coarse) group."""

    FIELDS = ("low", "high", "corner", "sets", "labels", "sizes", "most", "points")

    def __init__(self, sets, labels, sizes, most, counts: np.ndarray, corner: np.ndarray | None = None):
        self.sets, self.labels, self.sizes, self.most, self.counts = sets, labels, sizes, most, counts
        self.corner = corner if corner is not None else folded(counts, min(counts.shape[1], COARSE)).max(axis=0).astype(np.uint32)
        self.low, self.high = int(sizes[0]), int(sizes[-1])

    @classmethod
    def of(cls, rows: list[tuple]) -> Page:
        """Of (set, label, n, most, point), by size; points in more groups are folded to the fewest."""
        groups = 2 * min(len(r[4]) for r in rows)
        counts = np.minimum(np.concatenate([folded(counts_of(r[4]), groups) for r in rows]), FULL).astype(np.uint8)
        return cls(*(np.array([r[k] for r in rows], np.int64) for k in range(4)), counts)

    @classmethod
    def read(cls, r: dict, side: str) -> Page:
        sets, labels, sizes, most = (np.frombuffer(r[f"{c}_{side}"], np.int64) for c in ("sets", "labels", "sizes", "most"))
        return cls(sets, labels, sizes, most, counts_of(r[f"points_{side}"], len(sets)), np.frombuffer(r[f"corner_{side}"], np.uint32))

    def values(self) -> tuple:
        two = self.counts[:, ::2] | self.counts[:, 1::2] << 4
        return self.low, self.high, *(x.tobytes() for x in (self.corner, self.sets, self.labels, self.sizes, self.most, two))

    def meet(self, other: Page) -> tuple[np.ndarray, np.ndarray]:
        """Sets of this page and of ``other`` that may link, each pair once, the larger id first."""
        na, nb = self.sizes[:, None], other.sizes[None, :]
        able = (self.labels[:, None] != other.labels[None, :]) & (nb <= self.most[:, None]) & (na <= other.most[None, :])
        i, j = np.nonzero(np.triu(able, 1) if self is other else able)
        least = min(self.counts.shape[1], other.counts.shape[1])
        for groups in dict.fromkeys((min(COARSE, least), least)):
            u, v = folded(self.counts, groups), folded(other.counts, groups)
            step, hits = max(1, (1 << 22) // groups), [np.zeros(0, bool)]
            for o in range(0, len(i), step):
                x, y = i[o : o + step], j[o : o + step]
                hits.append(overlaps(u[x], v[y]) >= need(self.sizes[x], other.sizes[y]))
            hit = np.concatenate(hits)
            i, j = i[hit], j[hit]
        a, b = self.sets[i], other.sets[j]
        return np.maximum(a, b), np.minimum(a, b)


class Node:
    """Up to ``FAN`` pages under one box."""

    def __init__(self, pages: list[Page]):
        self.pages, self.low, self.high = pages, min(p.low for p in pages), max(p.high for p in pages)
        groups = min(len(p.corner) for p in pages)
        self.corner = np.max([p.corner.reshape(groups, -1).sum(axis=1, dtype=np.uint32) for p in pages], axis=0)


def reach(a, b) -> bool:
    """Whether sets of two boxes can overlap enough, by their sizes and upper corners."""
    groups = min(len(a.corner), len(b.corner))
    most = np.minimum(a.corner.reshape(groups, -1).sum(axis=1), b.corner.reshape(groups, -1).sum(axis=1)).sum()
    return 4 * a.high >= 3 * b.low and 4 * b.high >= 3 * a.low and int(most) >= need(a.low, b.low)


def descend(nodes: list[Node]):
    """Pairs that may link, of all points below the nodes of one child."""
    for k, x in enumerate(nodes):
        for y in nodes[k:]:
            if x is y or reach(x, y):
                for i, p in enumerate(x.pages):
                    for q in y.pages[i:] if x is y else y.pages:
                        if p is q or reach(p, q):
                            yield p.meet(q)


TREE = "a long, b long, child long, band int, node long, page long, low long, high long, corner binary, sets binary, labels binary, sizes binary, most binary, points binary"


def _tree(size: int):
    """Trees over rows sorted by child, band and size.

    A child of bounded size (no band) is descended here and put out as pairs (a, b). Of a larger one's bands the tree is
    put out: nodes (page -1) and their pages, which then meet in joins.
    """

    def run(batches):
        names, kinds = zip(*(c.split() for c in TREE.split(", ")))
        kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k] for k in kinds]
        at: tuple = (None, None)
        rows: list[tuple] = []
        nodes: list[Node] = []
        pages: list[Page] = []
        boxes: list[tuple] = []
        found: list[tuple] = []
        count = 0

        def close_node():
            nonlocal count
            if pages:
                node = Node(list(pages))
                pages.clear()
                if at[1] is None:
                    nodes.append(node)
                else:
                    boxes.append((None, None, *at, count, -1, node.low, node.high, node.corner.tobytes(), *[b""] * 5))
                    boxes.extend((None, None, *at, count, FAN * count + k, *p.values()) for k, p in enumerate(node.pages))
                    count += 1

        def close_page():
            if rows:
                pages.append(Page.of(rows))
                rows.clear()
                if len(pages) == FAN:
                    close_node()

        def close_child():
            nonlocal count
            close_page()
            close_node()
            found.extend(descend(nodes))
            nodes.clear()
            count = 0

        def made():
            if boxes:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*boxes), kinds)], names=list(names))
                boxes.clear()
            if found:
                a, b = (np.concatenate([f[k] for f in found]) for k in range(2))
                found.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), k) for k in kinds[2:])], names=list(names))

        for b in batches:
            for k, band, *row in zip(*(b[x].to_pylist() for x in ("child", "part", "set", "label", "n", "most", "point"))):
                if (k, band) != at:
                    close_child()
                    at = (k, band)
                elif len(rows) == size or rows and 3 * row[2] > 4 * rows[0][2]:
                    close_page()
                rows.append(tuple(row))
                if len(boxes) + len(found) >= 512:
                    yield from made()
        close_child()
        yield from made()

    return run


def _boxes(batches):
    for b in batches:
        keep = []
        for x, y, m, n in zip(*(b[c].to_pylist() for c in ("corner_a", "corner_b", "low_a", "low_b"))):
            u, v = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            groups = min(len(u), len(v))
            keep.append(int(np.minimum(u.reshape(groups, -1).sum(axis=1), v.reshape(groups, -1).sum(axis=1)).sum()) >= need(m, n))
        yield b.drop_columns(["corner_a", "corner_b", "low_a", "low_b"]).filter(pa.array(keep, pa.bool_()))


def _meet(batches):
    for b in batches:
        for k in range(b.num_rows):
            r = {c: b[c][k].as_py() for c in b.schema.names}
            x = Page.read(r, "a")
            y = x if r["itself"] else Page.read(r, "b")
            if x is y or reach(x, y):
                one, two = x.meet(y)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], names=["a", "b"])


def _candidates(live: DataFrame, page: int) -> DataFrame:
    """Pairs (a, b) of sets of different labels that may link, for (child, part, set, label, n, most, point)."""
    tree = materialize(live.repartition("child", "part").sortWithinPartitions("child", "part", "n", "set").mapInArrow(_tree(page), TREE), "tree")
    renamed = lambda df, s: df.toDF(*(c if c == "child" else f"{c}_{s}" for c in df.columns))
    later = F.explode(F.array("band_a", F.col("band_a") + 1)).alias("band_b")
    nodes = tree.where("page < 0").select("child", "band", "node", "low", "high", "corner")
    met = renamed(nodes, "a").select("*", later).join(renamed(nodes, "b"), ["child", "band_b"]).where("(band_a < band_b or node_a <= node_b) and 4 * high_a >= 3 * low_b")
    near = met.select("child", "band_a", "node_a", "band_b", "node_b", "corner_a", "corner_b", "low_a", "low_b").mapInArrow(_boxes, "child long, band_a int, node_a long, band_b int, node_b long")
    leaves = tree.where("page >= 0").drop("a", "b")
    pairs = near.join(renamed(leaves, "a"), ["child", "band_a", "node_a"]).join(renamed(leaves, "b"), ["child", "band_b", "node_b"])
    pairs = pairs.where("(band_a < band_b or page_a <= page_b) and 4 * high_a >= 3 * low_b").withColumn("itself", F.expr("band_a = band_b and page_a = page_b"))
    columns = [f"{c}_{s}" for s in "ab" for c in Page.FIELDS]
    far = pairs.select(*columns, "itself").mapInArrow(_meet, "a long, b long")
    found = materialize(tree.where("a is not null").select("a", "b").unionByName(far).distinct(), "pairs")
    discard(tree)
    return found


def near_sets(docs: DataFrame, page: int = PAGE, most: int = SHINGLES) -> tuple[DataFrame, DataFrame]:
    """For (doc_id, th, text): their signatures (doc_id, th, n, set), and the label of each set that links with another (set, label)."""
    counts = docs.mapInArrow(_count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # a fixed number of counters
    frequency = np.zeros(COUNTERS, np.int64)
    frequency[counts["counter"].to_numpy()] = counts["n"].to_numpy()
    rank = np.argsort(np.argsort(frequency, kind="stable"), kind="stable").astype(np.int32)
    signed = materialize(docs.mapInArrow(_sign(rank), "doc_id long, th long, n long, set long, keys binary, point binary"), "signed")
    one = F.min(F.struct("doc_id", "th", "n")).alias("one")
    children = signed.where("set is not null").groupBy("set").agg(F.min("n").alias("n"), F.min("keys").alias("keys")).mapInArrow(_children, "child long, set long, most int")
    twice = children.groupBy("child").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("child")
    shared = materialize(meet(children, twice, "child"), "shared")
    # two texts that share a passage meet under each of its shingles: children with the same sets are one, of so many
    # shingles; the first of them in the order stands for all, and there the bound on sizes is loosest for each of the sets
    alike = shared.groupBy("child").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("p"), F.bit_xor(F.xxhash64("set", F.lit(2))).alias("q"), F.max("most").alias("most"))
    some = alike.groupBy("k", "p", "q").agg(F.max(F.struct("most", "child"))["child"].alias("child"), F.count(F.lit(1)).alias("shingles")).select("child", "shingles")
    under = materialize(meet(shared, some, "child"), "under")
    discard(shared)

    involved = under.select("set").distinct()
    info = materialize(meet(signed.select("doc_id", "th", "n", "set"), involved, "set").groupBy("set").agg(one).select("set", "one.*"), "sets")
    sizes = info.select("set", "n")
    points = signed.where("set is not null").select("set", "point").groupBy("set").agg(F.min("point").alias("point"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose whole texts link."""
        sets = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
        ids = materialize(meet(info, sets, "set", "left_semi").select("doc_id", "th", "set"), "ids")
        likely = filtered(docs, ids, ["doc_id", "th"])
        texts = materialize(meet(likely, ids, likely["doc_id"].eqNullSafe(ids["doc_id"]) & (likely["th"] == ids["th"])).select("set", "text").dropDuplicates(["set"]), "texts")
        a = texts.select(F.col("set").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("set").alias("b"), F.col("text").alias("text_b"))
        links = materialize(meet(meet(pairs, a, "a"), b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"), "links")
        discard(ids, texts)
        return links

    # each set against a hub, the set of most shared children among those that it meets, where it meets that one under half
    # of its children. An original shares all its shingles with its copies while they don't share their edits, so hubs are
    # originals, and copies too unlike each other still join through them. This decides nothing: boxes find what it leaves
    degree = under.groupBy("set").agg(F.sum("shingles").alias("degree"))
    hubs = meet(under, degree, "set").groupBy("child").agg(F.max(F.struct("degree", "set"))["set"].alias("hub"))
    star = meet(under, hubs, "child").where("set <> hub").groupBy("set", "hub").agg(F.sum("shingles").alias("k")).groupBy("set").agg(F.max(F.struct("k", "hub")).alias("best")).select(F.col("set").alias("a"), F.col("best.hub").alias("b"), F.col("best.k").alias("k"))
    sa, sb = sizes.toDF("a", "na"), sizes.toDF("b", "nb")
    star = materialize(meet(meet(star, sa, "a").where("8 * k >= na"), sb, "b").where("4 * least(na, nb) >= 3 * greatest(na, nb)").select("a", "b", "na", "nb"), "star")
    stars = materialize(meet(meet(star, points.toDF("a", "point_a"), "a"), points.toDF("b", "point_b"), "b").mapInArrow(_able, "a long, b long"), "stars")
    first = verified(stars)
    labels = materialize(connected_components(first).toDF("set", "label"), "labels")
    discard(star, stars)

    # sets that meet under a child a set of another component that they can link with; only these bring their points
    band = F.floor(F.log(F.col("n")) / float(np.log(4 / 3))).cast("int")
    known = meet(sizes, labels, "set", "left").select("set", "n", F.coalesce("label", "set").alias("label"))
    rows = materialize(meet(under.select("child", "set", F.col("most").cast("long").alias("most")), known, "set"), "rows")
    large = rows.groupBy("child").agg(F.sum("n").alias("shingles")).where(F.col("shingles") > most).select("child", F.lit(True).alias("large"))
    placed = meet(rows, large, "child", "left").withColumn("part", F.when(F.col("large"), band)).select("child", "part", "set", "label", "n", "most")
    small = placed.where("part is null").repartition("child").sortWithinPartitions("child").mapInArrow(_meeting, placed.schema)
    live = meet(small.unionByName(placed.where("part is not null")), points, "set")
    pairs = _candidates(live, page)
    second = verified(pairs)
    discard(under, rows, info, pairs)
    return signed.select("doc_id", "th", "n", "set"), connected_components(first.unionByName(second)).toDF("set", "label")


def _classes(docs: DataFrame, id_col: str, text_col: str, **tree: int) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, label) for each row; label tells components apart that have the same smallest id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    signed, labels = near_sets(rows, **tree)
    least = signed.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("least"))
    least = meet(least, labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
    least = materialize(least, "least")
    whole = least.groupBy("label").agg(F.min("least").alias("component_id"))
    by_set = meet(least, whole, "label").select("set", "component_id", "label")
    out = meet(signed, by_set, "set", "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "label")


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **tree: int) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; ``tree`` sets ``page`` (points) and ``most`` (shingles of a child in one task).

    Documents link when their shingle sets reach Jaccard 3/4 (empty sets with nothing); component_id is the smallest id
    reachable, the document's own if it has no links. Rows that repeat an id count as documents of their own; a null id
    takes part and never is a component's id unless all are null. Other columns are ignored; an empty table gives none.
    """
    return _classes(docs, id_col, text_col, **tree).drop("th", "label")


def drop_near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, of which each group of linked ones keeps exactly one; texts without words stay.

    It is a row of the smallest id (a null one only where all are null), of its texts the one of smallest hash, and any
    one of the rows that are equal in both.
    """
    found = _classes(docs, id_col, text_col).where("n_shingles > 0")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    id_, hash_, stay, count = free_names(docs, "id", "hash", "stays", "rows")
    keys = meet(found, first, "label").groupBy(F.col("doc_id").alias(id_), F.col("th").alias(hash_)).agg(F.max(stays).alias(stay), F.count(F.lit(1)).alias(count))
    keys = materialize(keys.where(~F.col(stay) | (F.col(count) > 1)).select(id_, hash_, stay), "gone")

    rows = docs.withColumns({id_: F.col(id_col).cast("long"), hash_: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})

    def among(part: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return meet(part, keys, part[id_].eqNullSafe(keys[id_]) & (part[hash_] == keys[hash_]), how)

    kept = among(rows, keys, "left_anti").select(docs.columns)
    again = keys.where(stay).select(id_, hash_)
    if again.isEmpty():
        return kept
    one = among(filtered(rows, again, [id_, hash_]), again, "left_semi").dropDuplicates([id_, hash_])
    return kept.unionByName(one.select(docs.columns))
