"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

A token sequence is the result of the merges exactly when every adjacent pair in it is compatible: encoding the two
tokens' bytes together leaves both as they are. So the encoder walks left to right, takes the longest token that
starts at the place (from an Aho-Corasick automaton over the vocabulary), checks it against its predecessor in the
table of compatible pairs, tries the token's next shorter prefix where that fails, and steps back a token where all
fail; a bit per place keeps it from visiting a dead end twice, so time stays linear. Pair checks walk the merge tree
and are remembered.

Texts are first cut at the vocabulary's pre-token borders. A border lies before every white space that follows other
characters, so pieces between such borders are encoded once per task and looked up after that.
Decoding gathers each id's bytes through offsets into one array of all tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed value: the split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode White_Space, as ``\s`` of the tokenizers library has it (Python's own ``\s`` has four control characters more).
SPACE = "\t-\r \x85\xa0  -     　"
#: Pieces in each of the two generations that a worker remembers: bounds memory, never changes results.
REMEMBER = 400_000


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 stands for itself, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BacktrackingBPE:
    """Encoder and decoder for a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, model = byte_chars(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {bytes(chars[c] for c in k): i for k, i in model["vocab"].items() if k not in self.special}
        n = max([*ids.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * n
        for k, i in ids.items():
            self.tokens[i] = k
        for k, i in self.special.items():
            self.tokens[i] = k.encode()
        self.size = [len(t) for t in self.tokens]
        # the merge tree: which pair makes a token (left, right), and the token and its rank that a pair makes
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(n)]
        self.made: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank = [-1] * n  # single bytes come before all merges
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = bytes(chars[c] for c in a), bytes(chars[c] for c in b)
            made, pair = ids[a + b], (ids[a], ids[b])
            self.made[pair] = (r, made)
            if self.rank[made] < 0:
                self.rank[made], self.parts[made] = r, pair
        self.automaton = ahocorasick.Automaton()
        for k, i in ids.items():
            if self.rank[i] >= 0 or len(k) == 1:
                self.automaton.add_word(k.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [-1] * n  # the longest token that is a proper prefix
        for k, i in ids.items():
            for end in range(len(k) - 1, 0, -1):
                j = ids.get(k[:end])
                if j is not None and (self.rank[j] >= 0 or end == 1):
                    self.shorter[i] = j
                    break
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chunk = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.pretoken = regex.compile(PATTERN.replace(r"\S", f"[^{SPACE}]").replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]"))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay as they are when their bytes are merged together."""
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # walk both tokens' merge trees down along the border; a merge across it that comes first breaks them
        limit, made, parts, rank = 1 << 60, self.made, self.parts, self.rank
        while True:
            m = made.get((a, b))
            if m is not None and m[0] < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                limit, inner = ra, parts[a][1]
                if rank[a] < 0:
                    return True
                a = inner
            else:
                if rb < 0:
                    return True
                limit, b = rb + 1, parts[b][0]

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        n, size, fits, text = len(word), self.size, self.fits, word.decode("latin-1")
        # most words need no step back: all longest matches in a row are compatible
        out, last = [], -1
        for _, token in self.automaton.iter_long(text):
            if last >= 0:
                ok = fits.get(last << 32 | token)
                if not (self.compatible(last, token) if ok is None else ok):
                    break
            out.append(token)
            last = token
        else:
            return out
        longest = [-1] * n
        for end, token in self.automaton.iter(text):  # of one end the longest comes first, so of one start the last is longest
            longest[end + 1 - size[token]] = token
        out: list[int] = []
        alive = bytearray(b"\x01") * (n + 1)
        pos, token = 0, longest[0] if n else -1
        while pos < n:
            last = out[-1] if out else -1
            while True:
                end = pos + size[token]
                if alive[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    pos = end
                    token = longest[pos] if pos < n else -1
                    break
                if self.shorter[token] < 0:  # nothing fits here: the place is dead, shorten the token before it
                    alive[pos] = 0
                    token = out.pop()
                    pos -= size[token]
                    break
                token = self.shorter[token]
        return out

    def _piece(self, chunk: str) -> bytes:
        words = self.pretoken.findall(chunk)
        if len(words) == 1:
            return self._packed(self.encode_word(chunk.encode()))
        found = []
        for w in words:
            ids = self.pieces.get(w)
            if ids is None:
                ids = self._packed(self.encode_word(w.encode()))
                self._remember(w, ids)
            found.append(ids)
        return b"".join(found)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _remember(self, key: str, ids: bytes) -> None:
        if len(key) < 64:
            if len(self.pieces) >= REMEMBER:
                self.older, self.pieces = self.pieces, {}
            self.pieces[key] = ids

    def _plain(self, text: str) -> bytes:
        pieces, older, out = self.pieces, self.older, []
        for c in self.chunk.findall(text):
            ids = pieces.get(c)
            if ids is None:
                ids = older.get(c) or self._piece(c)
                self._remember(c, ids)
                pieces, older = self.pieces, self.older
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens' strings become their ids, as the library has it."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in self.cut.split(text) if p)

    def decode(self, ids: bytes) -> bytes:
        """The ids' bytes, gathered by offset."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(at):
            return b""
        size = self.offsets[at + 1] - self.offsets[at]
        ends = np.cumsum(size)
        gather = np.arange(ends[-1], dtype=np.int64)
        gather += np.repeat(self.offsets[at] - (ends - size), size)
        return self.blob[gather].tobytes()


_LOADED: dict[str, BacktrackingBPE] = {}


def loaded(path: str) -> BacktrackingBPE:
    """The encoder of a vocabulary file, kept by each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = BacktrackingBPE(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (string) for each row; a null text counts as empty.

    Rows are independent: no shuffle, and a lost task is computed again alone. Repeated rows are encoded each; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        bpe = loaded(path)
        for b in slices(batches):
            ids = [bpe.encode(t or "") for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.binary()), pa.array([bpe.decode(i).decode("utf-8", "replace") for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of :func:`encode_documents`, taken in the task so that ids stay there."""

    def run(batches):
        bpe = loaded(path)
        for b in slices(batches):
            ids = [bpe.encode(t or "") for t in b["text"].to_pylist()]
            back = [bpe.decode(i).decode("utf-8", "replace").encode() for i in ids]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
