"""Cost-balanced packing of tokenised documents into sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (the matrix products and the attention of a sequence whose
documents don't see each other). Whole sequences are cut off long documents first; what remains of each document is
packed in windows: the window's tokens fix how many sequences it needs, documents are taken from the costliest down,
and each goes to the sequence of lowest cost among all that have room for the whole of it. Only where no sequence has, it
is cut at the largest room, and what is left takes its turn by its own length. Only a window's last sequence can be
padded; one of a power of two isn't.

Windows lie within a task's rows, so there is no shuffle, memory is bounded by ``WINDOW`` tokens, and a lost task is
packed again alike (input order of a file split is fixed; ties go by id). Sequence ids are the partition's number and
a counter, so they don't collide.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

CAPACITY = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Tokens of the documents packed together: some two thousand sequences.
WINDOW = 1 << 22
END = 1
#: White space to Python that is none to the tokenizers' ``\s``: texts that hold one are encoded whole.
ODD = "\x1c\x1d\x1e\x1f"
#: Marks that end words; no vocabulary rule joins them to letters.
MARKS = ".,;:!?"
#: Words in each of the two generations that a worker remembers: bounds memory, never changes results.
REMEMBER = 250_000


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class WordEncoder:
    """Ids by the tokenizers library for a vocabulary that drops white space and marks word ends.

    Words between white space are encoded once and looked up after that. New words of letters alone are given to the
    library in one text, and the ids that end a word cut its answer; should their number differ, each is encoded alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                out += self._ids(some)
                continue
            raw, a = ids.tobytes(), 0
            for b in (cuts * 4).tolist():
                out.append(raw[a:b])
                a = b
        return out

    def _learn(self, new: Iterable[str]) -> None:
        words, older = self.words, self.older
        letters: dict[str, None] = {}
        odd: dict[str, None] = {}
        parts = []
        for w in new:
            core = w.rstrip(MARKS)
            tail = w[len(core) :]
            if not core.isalpha():
                odd[w] = None
                continue
            low = core.lower() if core.isascii() else core
            if low not in words:
                letters[low] = None
            if tail and tail not in words:
                odd[tail] = None
            if low is not w:
                parts.append((w, low, tail))
        fresh = []
        for w in letters:
            if w in older:
                words[w] = older[w]
            else:
                fresh.append(w)
        words.update(zip(fresh, self._letters(fresh)))
        words.update(zip(odd, self._ids(list(odd))))
        for w, low, tail in parts:
            words[w] = words[low] + words[tail] if tail else words[low]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.words) > REMEMBER:
            self.older, self.words = self.words, {}
        words, older = self.words, self.older
        found: list[list | None] = []
        new: dict[str, None] = {}
        gaps = []
        for t in texts:
            if any(c in t for c in ODD):
                found.append(None)
                continue
            ws = t.split()
            ids = list(map(words.get, ws))
            if None in ids:
                at = [k for k, x in enumerate(ids) if x is None]
                for k in at:
                    w = ws[k]
                    x = older.get(w)
                    if x is None:
                        new[w] = None
                    else:
                        words[w] = x
                gaps.append((ids, ws, at))
            found.append(ids)
        self._learn(new)
        for ids, ws, at in gaps:
            for k in at:
                ids[k] = words[ws[k]]
        for w in new:
            if len(w) > 64:
                del words[w]
        return [self._ids([t])[0] if ids is None else b"".join(ids) for t, ids in zip(texts, found)]


_LOADED: dict[str, WordEncoder] = {}


def loaded(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def assign(lengths: list[int], ids: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start within it, length, sequence, offset) of documents of at most ``capacity`` tokens, and the number of sequences.

    Lengths only fall, so a sequence that once has room for the current one stays open for all later ones until it is used:
    open sequences lie in a heap by cost, the others wait by their room.
    """
    total = sum(lengths)
    count = -(-total // capacity)
    if not count:
        return [], 0
    room = [capacity] * count
    room[-1] = total - capacity * (count - 1)
    size = list(room)
    spent = [0.0] * count
    queue = [(-lengths[i], ids[i], i, 0) for i in range(len(lengths)) if lengths[i]]
    heapq.heapify(queue)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for s in range(count):
        waiting[room[s]].append(s)
    open_: list[tuple[float, int]] = []
    least = capacity + 1  # sequences of this much room and more are open
    out = []
    while queue:
        left, key, d, start = heapq.heappop(queue)
        left = -left
        while least > left:
            least -= 1
            for s in waiting[least]:
                heapq.heappush(open_, (spent[s], s))
            waiting[least] = []
        if open_:
            _, s = heapq.heappop(open_)
            n = left
        else:
            n = next(r for r in range(left - 1, 0, -1) if waiting[r])
            s = min(waiting[n], key=lambda s: (spent[s], s))
            waiting[n].remove(s)
            heapq.heappush(queue, (n - left, key, d, start + n))
        out.append((d, start, n, s, size[s] - room[s]))
        room[s] -= n
        spent[s] += cost(n)
        if room[s] >= least:
            heapq.heappush(open_, (spent[s], s))
        elif room[s]:
            waiting[room[s]].append(s)
    return out, count


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids as bytes, if asked for).

    A document is its ids and the end id; a null or empty text is the end id alone. Every id lies in exactly one piece,
    and each sequence is filled gapless from 0. Repeated rows are packed each; a null id stays null; other columns are
    ignored; an empty table gives no pieces.
    """

    def run(batches):
        encoder = loaded(path)
        base = TaskContext.get().partitionId() << 33
        used = waiting = 0
        wait: list[tuple] = []  # (doc_id, start of the rest, ids of the rest, tokens of the document)

        def rows(pieces):
            cols = list(zip(*pieces)) if pieces else [()] * 8
            arrays = [pa.array(cols[i], pa.int64()) for i in range(7)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(cols[7], pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def packed():
            nonlocal used, waiting
            out, count = assign([len(w[2]) // 4 for w in wait], [w[0] if w[0] is not None else -1 for w in wait], capacity)
            made = []
            for d, start, n, s, offset in out:
                doc, before, ids, total = wait[d]
                part = ids[4 * start : 4 * (start + n)]
                made.append((doc, before + start, n, zlib.crc32(part), total, base + used + s, offset, part))
            used += count
            waiting = 0
            wait.clear()
            return rows(made)

        end = struct.pack("<I", END)
        for b in slices(batches):
            full = []
            for doc, ids in zip(b["doc_id"].to_pylist(), encoder.encode([t or "" for t in b["text"].to_pylist()])):
                ids += end
                total = len(ids) // 4
                whole = total // capacity * capacity
                for start in range(0, whole, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    full.append((doc, start, capacity, zlib.crc32(part), total, base + used, 0, part))
                    used += 1
                if whole < total:
                    wait.append((doc, whole, ids[4 * whole :], total))
                    waiting += total - whole
            if full:
                yield rows(full)
            if waiting >= WINDOW:
                yield packed()
        if wait:
            yield packed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, tokens, cost, padding) of packed sequences; one whose length is a power of two isn't padded."""
    n = F.sum("length")
    power = n.bitwiseAND(n - 1) == 0
    return pieces.groupBy("sequence_id").agg(n.alias("tokens"), F.sum(F.lit(LINEAR) * F.col("length") + F.lit(QUADRATIC) * F.col("length") * F.col("length")).alias("cost"), F.when(power, F.lit(0)).otherwise(CAPACITY - n).alias("padding"))
