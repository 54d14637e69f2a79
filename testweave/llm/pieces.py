"""SentencePiece encoding that keeps source offsets, and decoding.

A text is first normalised through the model's compiled character map: a double-array trie whose longest prefix at each
place gives the replacement. For every normalised byte the source byte it comes from is recorded. Pieces are made by
merging the adjacent pair of best score (leftmost of equals) until none is a piece; characters of no piece become bytes.
The normalised ends of the pieces, looked up in the alignment, are their spans in the source text.

No piece of a vocabulary that splits at white space has a space sign after another character, so words with the signs
before them are merged apart and remembered by each worker; a vocabulary that has such a piece is encoded text by text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SIGN = "▁"
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Words in each of the two generations that a worker remembers: bounds memory, never changes results.
REMEMBER = 300_000
#: Symbols of a word up to which the best pair is sought by scanning; beyond it a heap holds the pairs.
SCAN = 48


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of a serialised message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        shift = value = 0
        while True:
            c = data[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        elif key & 7 == 2:
            size = number()
            yield key >> 3, data[at : at + size]
            at += size
        elif key & 7 == 5:
            yield key >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif key & 7 == 1:
            yield key >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        else:
            raise ValueError("not a model file")


class CharacterMap:
    """Longest-prefix replacement by a compiled double-array trie (32-bit units) and its strings."""

    def __init__(self, blob: bytes):
        self.units, self.strings = [], b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.strings = blob[4 + size :]
        self.first = [False] * 256  # bytes with which some entry begins
        if self.units:
            root = self._offset(self.units[0])
            for b in range(1, 256):
                at = root ^ b
                self.first[b] = at < len(self.units) and self.units[at] & 0x800000FF == b

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest entry that begins at ``at``."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            if c == 0 or node >= len(units) or units[node] & 0x800000FF != c:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.strings[start : self.strings.index(b"\0", start)]


class Encoded(NamedTuple):
    """ids, and the first and the next byte of each piece in the source text's UTF-8 (an end id has an empty span at the end)."""

    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


class PieceModel:
    """Encoder and decoder of a byte-pair model file of the sentencepiece library."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._load(f.read())

    @classmethod
    def from_bytes(cls, data: bytes) -> PieceModel:
        self = cls.__new__(cls)
        self._load(data)
        return self

    def _load(self, data: bytes) -> None:
        pieces, trainer, normalizer = [], {}, {}
        for n, value in _fields(data):
            if n == 1:
                p = dict(_fields(value))
                pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif n == 2:
                trainer = dict(_fields(value))
            elif n == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a byte-pair model")
        self.map = CharacterMap(normalizer.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        self.end = next((i for i, p in enumerate(pieces) if p[2] == CONTROL and p[0] == trainer.get(47, b"</s>").decode()), None)
        self.kinds = [k for _, _, k in pieces]
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER, UNUSED)}
        self.scores = {p: s for p, s, k in pieces if k in (NORMAL, USER, UNUSED)}
        bytes_ = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.bytes = [bytes_[b] for b in range(256)] if trainer.get(35, 0) else None
        user = sorted((p for p, _, k in pieces if k == USER), key=len, reverse=True)
        self.user = re.compile("|".join(map(re.escape, user))) if user else None
        # the texts of pieces for decoding, as one array of bytes with offsets
        surface = trainer.get(44, b" \xe2\x81\x87 ")
        self.texts = [b"" if k == CONTROL else surface if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SIGN, " ").encode() for p, _, k in pieces]
        self.blob = np.frombuffer(b"".join(self.texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        self.signed = [p.startswith(SIGN) for p, _, k in pieces]
        self.names = [str(i) for i in range(len(pieces))]
        self.control = np.array([k == CONTROL for k in self.kinds])
        apart = SIGN in self.ids and not any(re.search(f"[^{SIGN}]{SIGN}", p) for p in self.ids)
        lines = self.bytes is not None and not any("\n" in p and len(p) > 1 for p in self.ids)
        self.words = re.compile((f"{SIGN}*[^{SIGN}\n]+|{SIGN}+|\n" if lines else f"{SIGN}*[^{SIGN}]+|{SIGN}+") if apart else ".+", re.DOTALL)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # --- normalisation

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised UTF-8 text, and for each of its bytes and its end the source byte it comes from."""
        if not data:
            return b"", np.zeros(1, np.int64)
        sign = SIGN.encode() if self.escape else b" "
        if not self.map.units and not self.squeeze:
            raw = np.frombuffer(data, np.uint8)
            own = np.arange(len(raw))
            if not data.isascii():  # all bytes of a character come from its first
                own = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, own, 0))
            align = np.repeat(own, np.where(raw == 32, len(sign), 1))
            out = data.replace(b" ", sign)
            head, tail = (len(sign) * (self.prefix and not self.suffix), len(sign) * (self.prefix and self.suffix))
            return sign[:head] + out + sign[:tail], np.concatenate([np.zeros(head, np.int64), align, np.full(tail + 1, len(raw))])
        return self._normalise(data, sign)

    def _normalise(self, data: bytes, sign: bytes) -> tuple[bytes, np.ndarray]:
        out, starts, sizes, at, n = [], [], [], 0, len(data)

        def put(text: bytes, source: int):
            out.append(text)
            starts.append(source)
            sizes.append(len(text))

        if self.squeeze:
            while at < n:
                size, text = self._prefix(data, at)
                if text != b" ":
                    break
                at += size
        if at == n:
            return b"", np.full(1, at, np.int64)
        if self.prefix and not self.suffix:
            put(sign, at)
        space = self.squeeze
        while at < n:
            size, text = self._prefix(data, at)
            if space:
                text = text.lstrip(b" ")
            if text:
                put(text.replace(b" ", sign), at)
                space = self.squeeze and text.endswith(b" ")
            at += size
        align = np.repeat(np.array(starts, np.int64), sizes)
        text = b"".join(out)
        end = at
        if self.squeeze:
            while text.endswith(sign):
                text = text[: -len(sign)]
                end = int(align[len(text)])
            align = align[: len(text)]
        tail = len(sign) * (self.prefix and self.suffix)
        return text + sign[:tail], np.concatenate([align, np.full(tail + 1, end)])

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        """(bytes taken, normalised) at a place: a symbol of the user's as it is, the longest entry, or one character."""
        first = data[at]
        if self.user is not None:
            m = self.user.match(data[at : at + 1024].decode("utf-8", "ignore"))
            if m:
                whole = m[0].encode()
                return len(whole), whole
        if self.map.first[first]:
            found = self.map.longest(data, at)
            if found:
                return found
        size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return size, data[at : at + size]

    # --- merging

    def _symbols(self, word: str) -> tuple[list[str], list[bool]]:
        if self.user is None:
            return list(word), []
        out, frozen, at = [], [], 0
        for m in self.user.finditer(word):
            out += [*word[at : m.start()], m[0]]
            frozen += [False] * (m.start() - at) + [True]
            at = m.end()
        return out + list(word[at:]), frozen + [False] * (len(word) - at)

    def merge(self, word: str) -> list[tuple[int, int]]:
        """(id, normalised bytes) of each piece of one word."""
        parts, frozen = self._symbols(word)
        unused: dict[str, tuple[str, str]] = {}
        if len(parts) > SCAN or any(frozen):
            parts = self._by_heap(parts, frozen, unused)
        elif len(parts) > 1:
            get, low = self.scores.get, -float("inf")
            pairs = [get(a + b, low) for a, b in zip(parts, parts[1:])]
            while pairs:
                best = max(pairs)
                if best == low:
                    break
                i = pairs.index(best)
                both = parts[i] + parts[i + 1]
                if self.kinds[self.ids[both]] == UNUSED:
                    unused[both] = (parts[i], parts[i + 1])
                parts[i : i + 2] = [both]
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = get(both + parts[i + 1], low)
                if i:
                    pairs[i - 1] = get(parts[i - 1] + both, low)
        out: list[tuple[int, int]] = []
        for p in parts:
            self._emit(p, unused, out)
        return out

    def _by_heap(self, parts: list[str], frozen: list[bool], unused: dict) -> list[str]:
        n, alive = len(parts), list(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int):
            if i < 0 or j < 0 or frozen and (frozen[i] or frozen[j]):
                return
            score = self.scores.get(alive[i] + alive[j])
            if score is not None:
                heapq.heappush(heap, (-score, i, j, len(alive[i]) + len(alive[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not alive[i] or not alive[j] or len(alive[i]) + len(alive[j]) != size or after[i] != j:
                continue
            both = alive[i] + alive[j]
            if self.kinds[self.ids[both]] == UNUSED:
                unused[both] = (alive[i], alive[j])
            alive[i], alive[j] = both, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in alive if p]

    def _emit(self, part: str, unused: dict, out: list[tuple[int, int]]) -> None:
        i = self.ids.get(part)
        if i is not None and self.kinds[i] == UNUSED and part in unused:
            for half in unused[part]:
                self._emit(half, unused, out)
        elif i is not None:
            out.append((i, len(part.encode())))
        elif self.bytes is not None:
            out += [(self.bytes[b], 1) for b in part.encode()]
        elif out and out[-1][0] == self.unknown:
            out[-1] = (self.unknown, out[-1][1] + len(part.encode()))
        else:
            out.append((self.unknown, len(part.encode())))

    def _pieces(self, text: str) -> bytes:
        found, older, out = self.known, self.older, []
        for w in self.words.findall(text):
            got = found.get(w)
            if got is None:
                got = older.get(w)
                if got is None:
                    got = b"".join(struct.pack("<II", *p) for p in self.merge(w))
                if len(w) < 64:
                    if len(found) >= REMEMBER:
                        self.older, self.known = found, {}
                        found, older = self.known, self.older
                    found[w] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str, end: bool = True) -> Encoded:
        """Pieces with their spans; ``end`` adds the model's end id."""
        data = text.encode()
        normal, align = self.normalise(data)
        pieces = np.frombuffer(self._pieces(normal.decode()), "<u4").reshape(-1, 2)
        cuts = align[np.concatenate([[0], np.cumsum(pieces[:, 1], dtype=np.int64)])]
        ids, begins, ends = pieces[:, 0], cuts[:-1], cuts[1:]
        if end:
            if self.end is None:
                raise ValueError("the model has no end id")
            ids, begins, ends = np.append(ids, np.uint32(self.end)), np.append(begins, len(data)), np.append(ends, len(data))
        return Encoded(ids, begins, ends)

    # --- decoding

    def decode(self, ids: np.ndarray) -> str:
        """The ids' text: pieces gathered by offset, the space that stands for the beginning taken off, bytes joined to characters."""
        at = ids.astype(np.int64)
        if not len(at):
            return ""
        size = self.offsets[at + 1] - self.offsets[at]
        ends = np.cumsum(size)
        gather = np.arange(ends[-1], dtype=np.int64)
        gather += np.repeat(self.offsets[at] - (ends - size), size)
        drop, empty = [], True
        if self.prefix or self.squeeze:
            for k in range(len(at)):  # pieces before the first text, in general one or two
                i = int(at[k])
                if self.kinds[i] == BYTE:
                    break
                if self.signed[i]:
                    drop.append(int(ends[k] - size[k]))
                    empty = size[k] == 1
                    if not self.squeeze:
                        break
                else:
                    empty = size[k] == 0
                if not empty:
                    break
        data = self.blob[np.delete(gather, drop) if drop else gather].tobytes()
        try:
            if not self.control[at[:-1]].any():  # one between bytes keeps them apart
                return data.decode()
        except UnicodeDecodeError:
            pass
        return self._decode(at, set(drop), ends - size)

    def _decode(self, at: np.ndarray, drop: set[int], starts: np.ndarray) -> str:
        """Where bytes form no characters: each byte that belongs to none becomes the replacement character."""
        out, run = [], b""
        for i, start in zip(at.tolist(), starts.tolist()):
            if self.kinds[i] == BYTE:
                run += self.texts[i]
                continue
            out += [_characters(run), self.texts[i][int(start in drop) :].decode()]
            run = b""
        return "".join([*out, _characters(run)])


def _characters(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        c = data[at]
        size = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
        try:
            out.append(data[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


_LOADED: dict[str, PieceModel] = {}


def loaded(path: str) -> PieceModel:
    """The model of a file, kept by each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, begins, ends (arrays; spans in bytes of the text's UTF-8) and decoded for each row.

    A null text counts as empty: its only piece is the end id. Rows are independent: no shuffle, and a lost task is
    computed again alone. Repeated rows are encoded each; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        model = loaded(path)
        for b in slices(batches):
            got = [model.encode(t or "", end) for t in b["text"].to_pylist()]
            columns = [pa.array([e[k].tolist() for e in got], pa.list_(pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *columns, pa.array([model.decode(e.ids) for e in got], pa.string())], names=["doc_id", "ids", "begins", "ends", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<long>, begins array<long>, ends array<long>, decoded string")


def encode_digests(docs: DataFrame, path: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by spaces), decoded_sha256, spans_sha256 (ends of the spans as little-endian 64-bit integers).

    The digests of what :func:`encode_documents` returns, taken in the task so that ids and spans stay there; nulls,
    repeated rows, other columns and empty tables as there.
    """

    def run(batches):
        model = loaded(path)
        digest = lambda rows: pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string())
        for b in slices(batches):
            got = [model.encode(t or "", end) for t in b["text"].to_pylist()]
            said = digest(" ".join(map(model.names.__getitem__, e.ids.tolist())).encode() for e in got)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(e.ids) for e in got], pa.int64()), said, digest(model.decode(e.ids).encode() for e in got), digest(e.ends.astype("<i8").tobytes() for e in got)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
