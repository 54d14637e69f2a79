"""Repeated passages: every byte covered by a 400-byte string that also starts elsewhere, by bucket-pointer refinement.

Suffixes are put in buckets by their first ``Q`` bytes; a bucket's identifier stands for its string. Refining a bucket to
twice the depth takes no bytes, only pointers: the identifier of depth 2d at a place is that of depth d there with that
of depth d at the later offset d, and what one depth has named, the next reuses (100, 200, 400 bytes; a longer string is
named by the buckets of its first and of its last 400 bytes). Buckets of one member are settled and never refined;
identifiers are 64-bit numbers that every executor makes alike, so refining needs counts only, never a bucket's members
in one place.

1. Of each 400-byte window the q-gram of smallest identifier is its anchor. Equal windows have equal anchors at equal
   distance, so only windows whose anchor's bucket holds two anchors or more go on.
2. The windows of one anchor start in one stretch. Anchors of a bucket that agree on the whole stretch are one member,
   repeated throughout if there are two or more of them. Where the bucket has other members, it is refined:
3. by runs of ``RUN`` neighbouring starts: what all windows of a run share (its core) is the finer bucket, members are the
   runs that agree throughout, and a bucket of one member is settled;
4. where it has several, start by start, by the windows' own identifiers.

Each member is resolved once, whatever the number of its copies, and those in one part of the text travel as one row with
their places, so a line repeated throughout a document or a hot passage costs few rows in the joins. A CRC of the bytes stands beside each identifier by which
strings count as equal. All counts combine before the shuffle, so a hot passage or a group of copies costs one row a
task. Texts move once for the documents that have repeats at all, which are then kept as a table of their own, and are
taken in pieces of ``PIECE`` bytes, so that the length of a text bounds no arrays.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_names, materialize, meet, slices, text_buffers

LENGTH = 400
Q = 100
RUN = 32
PLACES = 256
PIECE = 1 << 19

_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Grams:
    """Hashes of any substrings of a byte array, by differences of one running sum."""

    def __init__(self, data: np.ndarray):
        up, down = _power(len(data) + 1)
        self.up = up
        self.sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * down[: len(data)], out=self.sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.up[start])


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of each part, its place in the row's text) of texts, some ``size`` bytes at a time.

    Parts of one text overlap by a window less one byte, so that each window starts in exactly one part.
    """
    data, off = text_buffers(texts)
    parts: list[tuple[int, int, int]] = []
    total = 0

    def made():
        ends = np.cumsum([0, *(e - s for _, s, e in parts)])
        rows = np.array([r for r, _, _ in parts], np.int64)
        return np.concatenate([data[s:e] for _, s, e in parts]), ends, rows, np.array([s for _, s, _ in parts], np.int64) - off[rows]

    for row in range(len(off) - 1):
        s = int(off[row])
        while True:
            e = min(int(off[row + 1]), s + size + LENGTH - 1)
            if parts and total + e - s > size + LENGTH - 1:
                yield made()
                parts, total = [], 0
            parts.append((row, s, e))
            total += e - s
            s += size
            if e == off[row + 1]:
                break
    if parts:
        yield made()


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a bucket refined by another."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))))


class Buckets:
    """Bucket identifiers at the places of a byte array, by depth: first the q-grams', then by doubling the depth."""

    def __init__(self, data: np.ndarray):
        grams, at = Grams(data), np.arange(max(0, len(data) - Q + 1))
        self.data = data
        self.depth = {Q: grams(at, at + Q)}

    def of(self, depth: int) -> np.ndarray:
        if depth not in self.depth:
            half = self.of(depth // 2)
            self.depth[depth] = pair(half[: max(0, len(half) - depth // 2)], half[depth // 2 :])
        return self.depth[depth]

    def string(self, start: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
        """Identifiers of strings of ``depth`` to twice as many bytes: by the buckets of their first and of their last ones."""
        known = self.of(depth)
        return pair(known[start], known[end - depth] + (end - start).astype(np.uint64))

    def crc(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        view = memoryview(np.ascontiguousarray(self.data))
        return np.fromiter((zlib.crc32(view[s:e]) for s, e in zip(start.tolist(), end.tolist())), np.int64, len(start))


def windows(data: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 20) -> tuple[Buckets, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, starts of all whole windows, their documents, their anchors) over concatenated documents."""
    buckets = Buckets(data)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(np.arange(len(data)) + LENGTH <= offsets[1:][doc])
    if not len(starts):
        return buckets, starts, doc[:0], starts
    w, low = LENGTH - Q + 1, np.uint64(2 * chunk - 1)
    grams, anchor = buckets.of(Q), np.empty(len(data), np.int64)
    for a in range(0, len(grams), chunk):  # places within a chunk fit in the low bits, where the leftmost of equal q-grams wins
        n = min(chunk + w - 1, len(grams) - a)
        key = np.full(-(-n // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
        key[:n] = (grams[a : a + n] & ~low) | np.arange(n, dtype=np.uint64)
        blocks = key.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = min(chunk, len(grams) - a)
        anchor[a : a + n] = a + (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & low).astype(np.int64)
    return buckets, starts, doc[starts], anchor[starts]


def _first(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _columns(b: pa.RecordBatch, rows: np.ndarray, **more) -> pa.RecordBatch:
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays([b["doc_id"].take(at), b["th"].take(at), *(pa.array(v) for v in more.values())], names=["doc_id", "th", *more])


def _anchors(batches):
    for b in slices(batches):
        for data, off, rows, base in pieces(b["text"]):
            buckets, _, doc, anchor = windows(data, off)
            keep = _first(doc, anchor)
            doc, at = doc[keep], anchor[keep]
            yield _columns(b, rows[doc], at=base[doc] + at - off[doc], bucket=buckets.of(Q)[at].view(np.int64))


STRETCHES = "doc_id long, th long, lo long, ahead int, size int, bucket long, member long, crc long, n long, places array<struct<doc_id: long, th: long, lo: long, span: long>>"


def _stretches(batches):
    """Each live anchor's stretch of starts, as a member of the anchor's bucket; equal ones of a part of the text are one row with all their places."""
    for b in slices(batches):
        lists, flat = np.asarray(b["ats"].offsets), np.asarray(b["ats"].flatten())
        lists = lists - lists[0]
        for data, off, rows, base in pieces(b["text"]):
            buckets, starts, doc, anchor = windows(data, off)
            if not len(starts):
                continue
            here = [(flat[lists[r] : lists[r + 1]] - base[k], off[k], off[k + 1] - off[k]) for k, r in enumerate(rows)]
            live = np.sort(np.concatenate([o + at[(at >= 0) & (at < size)] for at, o, size in here]))
            new = _first(doc, anchor)
            first, last = starts[new], np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1])
            doc, anchor = doc[new], anchor[new]
            k = np.minimum(np.searchsorted(live, anchor), max(0, len(live) - 1))
            on = live[k] == anchor if len(live) else np.zeros(len(anchor), bool)
            doc, anchor, first, last = doc[on], anchor[on], first[on], last[on]
            bucket = buckets.of(Q)[anchor]
            member = pair(buckets.string(first, last + LENGTH, LENGTH), bucket + (anchor - first).astype(np.uint64))
            crc = buckets.crc(first, last + LENGTH)
            order = np.lexsort((crc, member))
            doc, anchor, first, last, bucket, member, crc = (x[order] for x in (doc, anchor, first, last, bucket, member, crc))
            place, row = _places(_first(member, crc), doc, first, last)
            lo, at = base[doc] + first - off[doc], place[row]
            n, span = np.diff(np.append(at, len(first))), np.add.reduceat(last - first + 1, place) if len(place) else place
            spots = _columns(b, rows[doc[place]], lo=lo[place], span=span)
            places = pa.ListArray.from_arrays(pa.array(np.append(row, len(place)).astype(np.int32)), pa.StructArray.from_arrays(spots.columns, names=spots.schema.names))
            yield _columns(b, rows[doc[at]], lo=lo[at], ahead=(anchor - first).astype(np.int32)[at], size=(last - first + 1).astype(np.int32)[at], bucket=bucket.view(np.int64)[at], member=member.view(np.int64)[at], crc=crc[at], n=n, places=places)


def _places(new: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which stretches open a place, which places open a row) of stretches ordered by member.

    Stretches of a member that follow each other without a gap, as in a line that is repeated throughout a document, are
    one place. A row holds a member's places, ``PLACES`` at most.
    """
    apart = new.copy()
    apart[1:] |= (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1)
    place = np.flatnonzero(apart)
    opens = np.flatnonzero(new[place])
    rank = np.arange(len(place)) - np.repeat(opens, np.diff(np.append(opens, len(place))))
    return place, np.flatnonzero(rank % PLACES == 0)


def _around(batches, many: int = 4096):
    """(batch, rows, items' fields, bytes, where each item's bytes begin), some items at a time.

    An item's bytes are those from its ``lo`` to the end of its last window.
    """
    for b in slices(batches, 64):
        items, data = pa.ListArray.flatten(b["items"]), text_buffers(b["text"])
        owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(b["items"].offsets)))
        for k in range(0, len(items), many):
            some = items.slice(k, many).flatten()
            x = {items.type[i].name: c.to_numpy(zero_copy_only=False) for i, c in enumerate(some)}
            length = x["size"].astype(np.int64) + LENGTH - 1
            begin = np.cumsum(length) - length
            start = data[1][owner[k : k + many]] + x["lo"]
            yield b, owner[k : k + many], x, data[0][np.repeat(start - begin, length) + np.arange(length.sum())], begin


RUNS = "doc_id long, th long, of long, of_crc long, n long, skip int, lo long, size int, core long, member long, crc long"


def _runs(batches):
    """The runs of each stretch, as members of the buckets of their cores."""
    for b, rows, x, data, begin in _around(batches):
        buckets, size, ahead = Buckets(data), x["size"].astype(np.int64), x["ahead"].astype(np.int64)
        near = (ahead - size + 1) // RUN
        count = ahead // RUN - near + 1
        k = np.repeat(np.arange(len(rows)), count)
        j = near[k] + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)  # by distance to the anchor, as in every stretch
        high, low = ahead[k] - RUN * j, ahead[k] - RUN * (j + 1) + 1
        lo, hi = np.maximum(low, 0), np.minimum(high, size[k] - 1)
        # the core lies within the stretch even where the stretch cuts the run
        core = pair(buckets.string(begin[k] + high, begin[k] + low + LENGTH, LENGTH // 2), x["bucket"].view(np.uint64)[k] + j.astype(np.uint64))
        cut = ((lo - low) * RUN + (high - hi)).astype(np.uint64)
        member = pair(buckets.string(begin[k] + lo, begin[k] + hi + LENGTH, LENGTH), core + cut)
        yield _columns(b, rows[k], of=x["member"][k], of_crc=x["crc"][k], n=x["n"][k], skip=lo.astype(np.int32), lo=x["lo"][k] + lo, size=(hi - lo + 1).astype(np.int32), core=core.view(np.int64), member=member.view(np.int64), crc=buckets.crc(begin[k] + lo, begin[k] + hi + LENGTH))


STARTS = "window long, window_crc long, member long, crc long, bit int, n long"


def _starts(batches):
    """The windows of each run, by identifier."""
    for _, rows, x, data, begin in _around(batches):
        k = np.repeat(np.arange(len(rows)), x["size"])
        bit = np.arange(len(k)) - np.repeat(np.cumsum(x["size"]) - x["size"], x["size"])
        at, buckets = begin[k] + bit, Buckets(data)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (buckets.of(LENGTH)[at].view(np.int64), buckets.crc(at, at + LENGTH), x["member"][k], x["crc"][k], bit.astype(np.int32), x["n"][k])], names=[c.split()[0] for c in STARTS.split(", ")])


def _covered(stretches, size: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by repeated windows; stretches are (lo, size, runs): wholly repeated, or where bits are set."""
    ranges = []
    for x in stretches:
        if x["runs"] is None:
            ranges.append((x["lo"], x["lo"] + x["size"] - 1))
        else:
            ranges += [(x["lo"] + r["skip"] + k,) * 2 for r in x["runs"] for k in range(RUN) if r["bits"] >> k & 1]
    found: list[list[int]] = []
    for a, b in sorted(ranges):
        if found and a <= found[-1][1]:
            found[-1][1] = max(found[-1][1], b + LENGTH)
        else:
            found.append([a, b + LENGTH])
    return [(a, min(b, size)) for a, b in found]


def kept_bytes(text: bytes, stretches) -> tuple[bytes, list[tuple[int, int]]]:
    spans = _covered(stretches, len(text))
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:a])
        last = b
    return b"".join(out) + text[last:], spans


def repeated_stretches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For (doc_id, th, text): the rows that have live anchors, and per (doc_id, th) their repeated starts, as ``_covered`` reads them."""
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    n = F.count(F.lit(1)).alias("n")
    anchors = materialize(docs.mapInArrow(_anchors, "doc_id long, th long, at long, bucket long"), "anchors")
    # tables of their own, so that both sides of a join are plain shuffles, of which Spark can split a hot bucket
    shared = materialize(anchors.groupBy("bucket").agg(n).where("n > 1").select("bucket"), "buckets")
    live = meet(anchors, shared, "bucket").groupBy("doc_id", "th").agg(F.collect_set("at").alias("ats"))
    active = materialize(meet(docs, live, same(docs, live)).select(docs["doc_id"], docs["th"], "text", "ats"), "active")
    discard(anchors, shared)

    def members(rows: DataFrame, bucket: str, weight, *fields: str) -> tuple[DataFrame, DataFrame]:
        """(the members of buckets with their weight and one place, those in buckets of several)."""
        all_ = materialize(rows.groupBy(bucket, "member", "crc").agg(weight.alias("n"), F.min(F.struct("doc_id", "th", *fields)).alias("one")).select(bucket, "member", "crc", "n", "one.*"), "members")
        several = materialize(all_.groupBy(bucket).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(bucket), "several")
        return all_, meet(all_, several, bucket)

    texts = active.select("doc_id", "th", "text").dropDuplicates(["doc_id", "th"])

    def with_texts(items: DataFrame, *fields: str) -> DataFrame:
        of = items.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*fields)).alias("items"))
        return meet(texts, of, same(texts, of)).select(of["doc_id"], of["th"], "text", "items")

    stretches = materialize(active.mapInArrow(_stretches, STRETCHES), "stretches")
    whole, open_ = members(stretches, "bucket", F.sum("n"), "lo", "ahead", "size")
    runs = materialize(with_texts(open_, "bucket", "member", "crc", "n", "lo", "ahead", "size").mapInArrow(_runs, RUNS), "runs")
    finer, open_ = members(runs, "core", F.sum("n"), "lo", "size")
    starts = materialize(with_texts(open_, "member", "crc", "n", "lo", "size").mapInArrow(_starts, STARTS), "starts")
    twice = starts.groupBy("window", "window_crc").agg(F.sum("n").alias("k")).where("k > 1").select("window", "window_crc")
    some = meet(starts, twice, ["window", "window_crc"]).groupBy("member", "crc").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    full = finer.where("n > 1").select("member", "crc", (F.expr("shiftleft(1L, size)") - 1).alias("bits"))
    bits = full.unionByName(some).groupBy("member", "crc").agg(F.bit_or("bits").alias("bits"))
    found = meet(runs, bits, ["member", "crc"]).groupBy(F.col("of").alias("member"), F.col("of_crc").alias("crc")).agg(F.collect_set(F.struct("skip", "bits")).alias("runs"))
    # stretches that are repeated throughout, and those that are in parts
    places = stretches.select("places", "member", "crc")
    through = meet(places, whole.where("n > 1").select("member", "crc"), ["member", "crc"], "left_semi").withColumn("runs", F.lit(None).cast(found.schema["runs"].dataType))
    parts = meet(places, meet(found, whole.where("n = 1").select("member", "crc"), ["member", "crc"], "left_semi"), ["member", "crc"])
    spots = through.unionByName(parts).select(F.explode("places").alias("at"), "runs").select("at.doc_id", "at.th", F.struct("at.lo", F.col("at.span").alias("size"), "runs").alias("run"))
    covered = materialize(spots.groupBy("doc_id", "th").agg(F.collect_list("run").alias("runs")), "covered")
    discard(stretches, whole, runs, finer, starts)
    return active, covered


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row.

    A null text counts as empty; texts under 400 bytes keep all but what they can't repeat: everything. Rows that repeat
    an id and a text are copies of each other; a null id is a document like any other; other columns are ignored; an
    empty table gives an empty result.
    """
    rows = _prepared(docs, id_col, text_col)
    active, covered = repeated_stretches(rows)

    def cut(batches):
        for b in slices(batches, 64):
            removed, n, sha = [], [], []
            for t, r in zip(b["text"].to_pylist(), b["runs"].to_pylist()):
                kept, spans = kept_bytes(t.encode(), r)
                removed.append(sum(e - s for s, e in spans))
                n.append(len(spans))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["th"], pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "th", "n_removed", "n_spans", "sha"])

    texts = active.select("doc_id", "th", "text").dropDuplicates(["doc_id", "th"])
    joined = meet(texts, covered, texts["doc_id"].eqNullSafe(covered["doc_id"]) & (texts["th"] == covered["th"])).select(texts["doc_id"], texts["th"], "text", "runs")
    found = joined.mapInArrow(cut, "doc_id long, th long, n_removed long, n_spans long, sha string")
    base = rows.select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("own"))
    out = meet(base, found, base["doc_id"].eqNullSafe(found["doc_id"]) & (base["th"] == found["th"]), "left")
    zero = F.lit(0).cast("long")
    return out.select(base["doc_id"], "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the text; a character that a cut splits goes too. All other columns stay.

    A null text stays null, an empty one empty; rows that repeat an id and a text are copies of each other; a null id is a
    document like any other; an empty table gives an empty one.
    """
    rows = _prepared(docs, id_col, text_col)
    _, covered = repeated_stretches(rows)
    row, hash_, runs = free_names(docs, "row", "hash", "runs")
    covered = covered.toDF(row, hash_, runs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = meet(docs, covered, docs[id_col].cast("long").eqNullSafe(covered[row]) & (F.xxhash64(text) == covered[hash_]), "left").drop(row, hash_)
    at, names = docs.columns.index(text_col), docs.columns

    def cut(batches):
        for b in slices(batches, 64):
            texts = [t if r is None or t is None else kept_bytes(t.encode(), r)[0].decode("utf-8", "ignore") for t, r in zip(b.column(at).to_pylist(), b[runs].to_pylist())]
            cols = list(b.columns)[:-1]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(cut, docs.schema)
