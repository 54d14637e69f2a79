import struct
import zlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from testweave.llm.packing import CAPACITY, assign, cost, loaded, pack_documents, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(alphabet="ab 'S\n\t\x1c\x85İΣ<|startofx|>", max_size=60), max_size=5))
def test_ids_equal_the_library(texts):
    texts = [*texts, "a<|endoftext|>b", "é é \x1f x", "ΑΣ ΑΣ."]
    got = [list(struct.unpack(f"<{len(i) // 4}I", i)) for i in loaded(PATH).encode(texts)]
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_assignment_fills_sequences(lengths):
    pieces, count = assign(lengths, list(range(len(lengths))), 50)
    assert count == -(-sum(lengths) // 50)
    fill = {}
    for d, start, n, s, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert n > 0 and fill.get(s, 0) == offset
        fill[s] = offset + n
    assert sorted(fill.values())[1:] == [50] * (count - 1) if count else not fill
    for d, size in enumerate(lengths):
        own = sorted((p[1], p[2]) for p in pieces if p[0] == d)
        assert own[0][0] == 0 and sum(n for _, n in own) == size and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:]))


def test_documents(spark):
    texts = {1: None, 2: "", 3: "Hello  World", 4: "word " * 7000, 5: "x y z " * 300, 6: "Hello  World"} | {i: f"some words {i} " * (i % 90) for i in range(10, 200)}
    rows = [(i, t, 0, "x") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, ids string")
    pieces = pack_documents(docs, PATH, with_ids=True)
    got = pieces.collect()
    want = {i: LIBRARY.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    for i, ids in want.items():
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        at = 0
        for r in own:
            part = struct.pack(f"<{r.length}I", *ids[at : at + r.length])
            assert (r.start, r.doc_tokens, bytes(r.ids), r.ids_crc32) == (at, len(ids), part, zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= CAPACITY
    stats = sequences(pieces).collect()
    assert sum(r.tokens for r in stats) == sum(map(len, want.values()))
    assert sum(r.padding for r in stats) < 5 * CAPACITY
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_costs_are_even():
    lengths = [1 + (i * 37) % 900 for i in range(800)]
    pieces, count = assign(lengths, list(range(800)))
    by = [0.0] * count
    for _, _, n, s, _ in pieces:
        by[s] += cost(n)
    assert max(by[:-1]) < 1.25 * sum(by[:-1]) / (count - 1)
