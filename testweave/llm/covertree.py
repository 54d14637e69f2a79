"""Embedding near-duplicates: exact cosine links by a dual traversal of cover trees.

Unit vectors u, v have cosine >= t exactly when |u - v| <= sqrt(2 - 2 t), so the join is a metric range join. A tree
has nested levels whose radii halve; a node keeps the covering radius of what lies below it, and a pair of nodes is
dropped when the distance of their centres exceeds both radii plus the range. Whatever the tree looks like, that drops
no pair in range, so the links are exact.

Distribution: the top of the tree is built on the driver from a bounded sample (``SAMPLE`` vectors) and only routes:
every vector goes to the cell of a top node, whose covering radius is then aggregated over all its vectors. Cells are
split into blocks of about ``BLOCK`` vectors by hash, each block's tree is built once and travels with it whole, pairs of
cells that the bound keeps become pairs of tiles (one block each, or up to ``TILE`` where there are many), and a task takes
one pair of tiles and traverses their trees together. Pairs are taken in rounds of some left tiles each, so that what a
round shuffles is about twice the blocks and goes before the next: the disk grows with the table, not with its square.
Copies of one vector are a single point with a count, so a vector that a third of the rows share costs one point.

In data without neighbourhoods (random directions in 64 dimensions) covering radii exclude nothing but single points,
so the traversal ends in matrix products of all blocks: exact, but quadratic. Clustered data is pruned by cell.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected_components

SAMPLE = 2048
MAX_CELLS = 256
BLOCK = 4096
#: Blocks in a tile at most, blocks that a round may shuffle at least, and tables of links before they become one.
TILE, ROUND, PARTS = 8, 256, 32
LEAF = 48
SLACK = 1e-9
BLOCK_COLUMNS = ("ids", "ns", "xs", "order", "nodes")
#: A tree's nodes in preorder: centre, rows below, children, covering radius, the level's radius.
NODE = np.dtype([("centre", "<i8"), ("rows", "<i8"), ("children", "<i8"), ("radius", "<f8"), ("level", "<f8")])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def cover(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy centres (row numbers), about ``radius`` apart at least, and each row's nearest centre (a position there).

    Single precision is enough: any choice of centres gives a valid tree, since covering radii are measured afterwards.
    """
    x, close = x.astype(np.float32), np.float32(1.0 - radius * radius / 2.0)
    centres: list[int] = []
    left = np.arange(len(x))
    while len(left):
        some, fresh = left[:256], []
        near = x[some] @ x[some].T >= close
        taken = np.zeros(len(some), bool)
        for i in range(len(some)):
            if not taken[i]:
                fresh.append(some[i])
                taken |= near[i]
        centres += fresh
        far = np.ones(len(left), bool)
        for i in range(0, len(left), 1024):
            far[i : i + 1024] = (x[left[i : i + 1024]] @ x[fresh].T).max(axis=1) < close
        far[np.isin(left, fresh)] = False
        left = left[far]
    at, own = np.array(centres), np.empty(len(x), np.int64)
    for i in range(0, len(x), 1024):
        own[i : i + 1024] = (x[i : i + 1024] @ x[at].T).argmax(axis=1)
    own[at] = np.arange(len(at))
    return at, own


class Node:
    """A tree node: its centre, the rows below it, their covering radius, the level's radius; children are made on demand."""

    def __init__(self, x: np.ndarray, centre: int, rows: np.ndarray, level: float, radius: float | None = None):
        self.x, self.centre, self.rows, self.level = x, centre, rows, level
        self.radius = radius if radius is not None else float(_dist(x[rows], x[centre : centre + 1]).max()) if len(rows) > 1 else 0.0
        self._below: list[Node] | None = None

    @property
    def leaf(self) -> bool:
        return len(self.rows) <= LEAF or self.level < 1e-3

    def below(self) -> list[Node]:
        if self._below is None:
            half = self.level / 2
            while True:
                at, own = cover(self.x[self.rows], half)
                if len(at) > 1 or half < 1e-3:
                    break
                half /= 2
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(len(at) + 1))
            self._below = [Node(self.x, int(self.rows[c]), self.rows[order[cuts[i] : cuts[i + 1]]], half) for i, c in enumerate(at)]
        return self._below

    def whole(self) -> tuple[bytes, bytes]:
        """The tree down to its leaves as bytes (rows in preorder, nodes), so that it is built once and travels with its block."""
        nodes: list[tuple] = []
        order: list[np.ndarray] = []

        def walk(n: Node):
            below = [] if n.leaf else n.below()
            nodes.append((n.centre, len(n.rows), len(below), n.radius, n.level))
            if below:
                for c in below:
                    walk(c)
            else:
                order.append(n.rows)

        walk(self)
        return np.concatenate(order).astype(np.int64).tobytes(), np.array(nodes, NODE).tobytes()

    @classmethod
    def of(cls, x: np.ndarray, order: bytes, nodes: bytes) -> Node:
        rows, table = np.frombuffer(order, np.int64), np.frombuffer(nodes, NODE).tolist()
        at = start = 0

        def read() -> Node:
            nonlocal at, start
            centre, size, children, radius, level = table[at]
            at += 1
            node = cls(x, centre, rows[start : start + size], level, radius)
            if children:
                node._below = [read() for _ in range(children)]
            else:
                start += size
            return node

        return read()


def dual_pairs(a: Node, b: Node, limit: float):
    """Yield (rows of a, rows of b) with cosine >= ``limit``, by descending both trees at once; for a is b every pair comes in both directions.

    What no bound excludes meets in products of single precision with a margin, a leaf with all the leaves that it
    reaches at once; what passes is measured in double precision.
    """
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * limit)))
    x, y = a.x, b.x
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    close = np.float32(limit - 1e-5)

    def exact(r: np.ndarray, q: np.ndarray):
        for s in range(0, len(r) * bool(len(q)), 512):
            i, j = np.divmod(np.flatnonzero(x32[r[s : s + 512]] @ y32[q].T >= close), len(q))
            i, j = r[s + i], q[j]
            hit = np.einsum("ij,ij->i", x[i], y[j]) >= limit
            if hit.any():
                yield i[hit], j[hit]

    def met(few: list[Node], many: list[Node], u: np.ndarray, v: np.ndarray):
        """(node of ``few``, rows of the leaves of ``many`` that it meets as a leaf, the other nodes that it reaches)."""
        radii, centres = np.array([n.radius for n in many]), [n.centre for n in many]
        leaves = np.array([n.leaf for n in many])
        flat = np.concatenate([n.rows for n in many])
        owner = np.repeat(np.arange(len(many)), [len(n.rows) for n in many])
        for s in range(0, len(few), 512):
            some = few[s : s + 512]
            near = _dist(u[[n.centre for n in some]], v[centres]) <= np.array([n.radius for n in some])[:, None] + radii[None, :] + reach + SLACK
            for n, row in zip(some, near):
                at_once = row & leaves & n.leaf
                yield n, flat[at_once[owner]], [many[k] for k in np.flatnonzero(row & ~at_once)]

    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        if p.leaf and q.leaf:
            yield from exact(p.rows, q.rows)
            continue
        ps = [p] if p.leaf else p.below()
        qs = [q] if q.leaf else q.below()
        (pm, p1), (qm, q1) = (([n for n in side if len(n.rows) > 1], [n for n in side if len(n.rows) == 1]) for side in (ps, qs))
        if pm:
            for n, rows, others in met(pm, qs, x, y):
                yield from exact(n.rows, rows)
                stack += [(n, m) for m in others]
        if p1 and qm:
            for n, rows, others in met(qm, p1, y, x):
                yield from exact(rows, n.rows)
                stack += [(m, n) for m in others]
        yield from exact(*(np.array([n.centre for n in side], int) for side in (p1, q1)))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row number reachable over the links, for each of n rows."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _pack(key, t):
    """One row per block: ids, counts and vectors of its members as bytes."""
    x = np.array(t["vec"].to_pylist(), dtype=np.float64)
    row = [k.as_py() for k in key]
    ids, n = t["rep"].to_numpy().astype(np.int64), t["copies"].to_numpy().astype(np.int64)
    order = np.argsort(ids)
    x = unit(x)[order]
    order_, nodes = Node(x, 0, np.arange(len(x)), 2.0).whole()
    return pa.table({"dim": pa.array([row[0]], pa.int32()), "cell": pa.array([row[1]], pa.int32()), "chunk": pa.array([row[2]], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "ns": pa.array([n[order].tobytes()], pa.binary()), "xs": pa.array([x.tobytes()], pa.binary()), "order": pa.array([order_], pa.binary()), "nodes": pa.array([nodes], pa.binary())})


def _join_tiles(limit: float):
    none = pa.table({c: pa.array([], pa.int64()) for c in ("rep", "more", "low")})

    def run(key, t):
        sides: list[list] = [[], []]
        for r in sorted(t.to_pylist(), key=lambda r: r["chunk"]):
            ids, n = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ns"], np.int64)
            x = np.frombuffer(r["xs"], np.float64).reshape(len(ids), -1)
            sides[r["side"]].append((ids, n, Node.of(x, r["order"], r["nodes"])))
        left, right = sides
        _, cell_a, cell_b, tile_a, tile_b = (k.as_py() for k in key)
        itself = cell_a == cell_b and tile_a == tile_b
        pairs = [(a, b) for i, a in enumerate(left) for b in (left[i:] if itself else right)]
        return pa.concat_tables([none, *(met(a, b) for a, b in pairs)])

    def met(a, b):
        (ia, na, ta), (ib, nb, tb) = a, b
        same = a is b
        shift = 0 if same else len(ia)
        links = np.zeros(shift + len(ib), np.int64)
        li, lj = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in dual_pairs(ta, tb, limit):
            if same:
                i, j = i[i != j], j[i != j]
            links += np.bincount(i, weights=nb[j], minlength=len(links)).astype(np.int64)
            if not same:
                links += np.bincount(j + shift, weights=na[i], minlength=len(links)).astype(np.int64)
            li.append(i)
            lj.append(j + shift)
        ids = ia if same else np.concatenate([ia, ib])
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        low = _forest(len(ids), place[np.concatenate(li)], place[np.concatenate(lj)])
        some = links > 0
        return pa.table({"rep": ids[some], "more": links[some], "low": ids[order][low[place]][some]})

    return run


def _rounds(pairs: list[tuple], n_blocks: int) -> tuple[int, list[list[tuple]]]:
    """Blocks in a tile, and the pairs of cells (dim, cell_a, cell_b, blocks of both) as rounds of (dim, cell_a, cell_b, tile_a, tiles of cell_b).

    A round takes left tiles until what it shuffles, their copies and the blocks that they meet, is twice all blocks.
    """
    size = max(1, min(TILE, n_blocks // (16 * TILE)))
    tiles = lambda n: -(-n // size)
    rounds: list[list[tuple]] = [[]]
    sent = 0
    for d, a, b, n_a, n_b in sorted(pairs):
        for t in range(tiles(n_a)):
            cost = min(size, n_a) * tiles(n_b) + n_b
            if rounds[-1] and sent + cost > max(2 * n_blocks, ROUND):
                rounds.append([])
                sent = 0
            rounds[-1].append((d, a, b, t, tiles(n_b)))
            sent += cost
    return size, [r for r in rounds if r]


def near_embeddings(vectors: DataFrame, limit: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of unequal
    lengths don't link. Rows with a null id come back with no links; rows that repeat an id count as further vectors and
    share that id's component. Other columns are ignored. An empty table gives an empty result.
    """
    v = F.col("vec")
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("vec") > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("vec", lambda c: c != 0), F.lit(False))
    points = materialize(rows.where(ok).groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("vec")), "points")

    tops: dict[int, np.ndarray] = {}
    for r in points.select("rep", "vec", "dim").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect():
        tops.setdefault(r["dim"], []).append(r["vec"])  # type: ignore[arg-type]
    for d, vs in tops.items():
        x = unit(np.array(vs))
        centres, radius = x[:1], 2.0
        while len(x) > 1:
            radius /= 2
            at, _ = cover(x, radius)
            if len(at) > MAX_CELLS or radius < 0.05:
                break
            centres = x[at]
        tops[d] = centres

    def route(batches):
        for b in batches:
            dims, vs = b["dim"].to_numpy(), b["vec"].to_pylist()
            cell, far = np.full(len(dims), -1, np.int32), np.full(len(dims), 2.0)
            for d in np.unique(dims):
                if int(d) in tops:
                    k = np.nonzero(dims == d)[0]
                    dist = _dist(unit(np.array([vs[i] for i in k])), tops[int(d)])
                    cell[k], far[k] = dist.argmin(axis=1), dist.min(axis=1)
            yield pa.RecordBatch.from_arrays([b["rep"], b["copies"], b["vec"], b["dim"], pa.array(cell), pa.array(far)], names=["rep", "copies", "vec", "dim", "cell", "far"])

    routed = materialize(points.mapInArrow(route, "rep long, copies long, vec array<double>, dim int, cell int, far double"), "routed")
    cells = routed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect()  # at most MAX_CELLS a dimension
    chunks = {(c["dim"], c["cell"]): max(1, -(-c["n"] // BLOCK)) for c in cells}
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * limit)))
    pairs = []
    for c in cells:
        for e in cells:
            if c["dim"] == e["dim"] and c["cell"] <= e["cell"]:
                t = tops.get(c["dim"])
                gap = 0.0 if t is None or c["cell"] < 0 or e["cell"] < 0 else float(_dist(t[c["cell"] : c["cell"] + 1], t[e["cell"] : e["cell"] + 1])[0, 0])
                if gap <= c["r"] + e["r"] + reach + SLACK:
                    pairs.append((c["dim"], c["cell"], e["cell"], chunks[c["dim"], c["cell"]], chunks[e["dim"], e["cell"]]))
    spark = vectors.sparkSession
    n_chunks = spark.createDataFrame([(d, c, n) for (d, c), n in chunks.items()], "dim int, cell int, n_chunks int")
    blocks = routed.join(F.broadcast(n_chunks), ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("n_chunks")).cast("int")).groupBy("dim", "cell", "chunk").applyInArrow(_pack, f"dim int, cell int, chunk int, {', '.join(f'{c} binary' for c in BLOCK_COLUMNS)}")
    blocks = materialize(blocks, "blocks")
    discard(routed)
    parts: list[DataFrame] = []
    size, rounds = _rounds(pairs, sum(chunks.values()))
    for some in rounds:
        links = spark.createDataFrame(some, "dim int, cell_a int, cell_b int, tile_a int, n_b int")
        mine = blocks.withColumn("tile", F.floor(F.col("chunk") / size).cast("int"))
        kept = ["dim", "cell_a", "cell_b", "tile_a", "tile_b", "side", "chunk", *BLOCK_COLUMNS]
        one_cell = F.col("cell_a") == F.col("cell_b")
        first = F.when(one_cell, F.col("tile_a")).otherwise(0)
        left = mine.join(F.broadcast(links.withColumnsRenamed({"cell_a": "cell", "tile_a": "tile"})), ["dim", "cell", "tile"]).withColumnsRenamed({"cell": "cell_a", "tile": "tile_a"}).withColumns({"tile_b": F.explode(F.sequence(first, F.col("n_b") - 1)), "side": F.lit(0)})
        right = mine.withColumnsRenamed({"cell": "cell_b", "tile": "tile_b"}).join(F.broadcast(links), ["dim", "cell_b"]).where(~one_cell | (F.col("tile_a") < F.col("tile_b"))).withColumn("side", F.lit(1))
        met = left.select(*kept).unionByName(right.select(*kept))
        parts.append(materialize(met.groupBy("dim", "cell_a", "cell_b", "tile_a", "tile_b").applyInArrow(_join_tiles(limit), "rep long, more long, low long"), "links"))
        if len(parts) == PARTS:
            whole = materialize(reduce(DataFrame.unionByName, parts), "links")
            discard(*parts)
            parts = [whole]
    discard(blocks)
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "rep long, more long, low long")

    label = connected_components(found.select("rep", "low"))
    more = found.groupBy("rep").agg(F.sum("more").alias("more"))
    per_point = points.select("vec", "rep", "copies").join(more, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("vec", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = rows.where(ok).join(per_point, "vec").select("vec_id", "n_links", "component_id")
    rest = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
