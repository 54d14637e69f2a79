import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from testweave.llm import pieces
from testweave.llm.pieces import PieceModel, encode_digests, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = "ab  the▁\n\t <s></s>ﬁＡé\x00漢字😀  'ing0123ŕ①​　"


def field(n, value):
    def number(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    if isinstance(value, float):
        return number(n << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return number(n << 3) + number(value)
    return number(n << 3 | 2) + number(len(value)) + value


def model(words, *, bytes_=False, user=(), unused=(), charsmap=b"", prefix=1, squeeze=0, escape=1):
    """A model file made by hand: single letters, then the words by falling score."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if bytes_ else []
    rows += [(u, 0.0, 4) for u in user]
    rows += [(w, -float(i), 5 if w in unused else 1) for i, w in enumerate(words)]
    rows += [(c, -1000.0 - i, 1) for i, c in enumerate("▁abcdefghi")]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in rows)
    trainer = field(3, 2) + field(35, int(bytes_)) + field(40, 0) + field(41, 1) + field(42, 2)
    return out + field(2, trainer) + field(3, field(1, b"x") + field(2, charsmap) + field(3, prefix) + field(4, squeeze) + field(5, escape))


def charsmap(rule):
    proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    normalizer = dict(pieces._fields(proto))[3]
    return dict(pieces._fields(normalizer))[2]


def same(mine, library, text):
    got, want = mine.encode(text), library.encode(text, return_type="proto")
    assert got.ids.tolist() == library.encode(text, add_eos=True)
    assert mine.decode(got.ids) == library.decode(got.ids.tolist())
    assert list(zip(got.begins.tolist(), got.ends.tolist()))[:-1] == [(p.begin, p.end) for p in want.pieces]


@pytest.fixture(scope="module")
def both():
    return PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=ODD, max_size=60)))
def test_equals_the_library(both, text):
    same(*both, text)


@pytest.mark.parametrize("text", ["", " ", "\n", "▁", "▁▁a", " " * 70, "a" * 3000, " " * 3000 + "b", "word " * 3000, " x", "ab\r\ncd"])
def test_edges_equal_the_library(both, text):
    same(*both, text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_character_maps(rule, squeeze):
    words = ["ab", "▁a", "▁ab", "cd", "abcd", "fi", "▁fi", "▁▁", "aa", "aaaa"]
    data = model(words, bytes_=True, charsmap=charsmap(rule), squeeze=squeeze)
    mine, library = PieceModel.from_bytes(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(3)
    for text in ["ＡＢ ﬁ  cd①", "  a  ", "　ab　", "ﬁ", "é", "éŕ", "​ab", "①②"] + ["".join(rng.choice(ODD + "cdfi ") for _ in range(rng.randint(0, 30))) for _ in range(400)]:
        same(mine, library, text)


@pytest.mark.parametrize("options", [{"user": ("<x>", "a▁b")}, {"unused": ("abc", "cd")}, {"prefix": 0}, {"squeeze": 1}, {"bytes_": True, "user": ("\nb",)}])
def test_other_models(options):
    data = model(["ab", "abc", "▁a", "cd", "bcd", "▁▁", "ghi", "hi", "c▁d"][: 9 if "prefix" in options else 8], **options)
    mine, library = PieceModel.from_bytes(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(5)
    for _ in range(500):
        same(mine, library, "".join(rng.choice("abcdghi  <x>zé\n▁") for _ in range(rng.randint(0, 14))))


def test_any_ids_decode_as_the_library_has_it(both):
    mine, library = both
    rng = random.Random(1)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300), 0, 1, 2, 259, 28705]) for _ in range(rng.randint(0, 8))]
        assert mine.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_memory_of_words_never_changes_results(both, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBER", 3)
    mine = PieceModel(PATH)
    text = "one two three four five one two three six seven one two " * 5
    assert mine.encode(text).ids.tolist() == both[1].encode(text, add_eos=True)
    assert len(mine.known) <= 3 and len(mine.older) <= 3


def test_rows(spark, both):
    long = "lorem ipsum é 漢 " * 40_000
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (2, None, None, None), (3, "", "", 0), (None, "no id", "y", 2), (5, long, "z", 3), (6, "x" * 20_000, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = sorted(map(tuple, encode_digests(docs, PATH).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, text, *_ in rows:
        ids = both[1].encode(text or "", add_eos=True)
        ends = [p.end for p in both[1].encode(text or "", return_type="proto").pieces] + [len((text or "").encode())]
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(both[1].decode(ids).encode()), sha(np.array(ends, "<i8").tobytes())))
    assert got == sorted(want, key=str)
    spans = {r.doc_id: r for r in encode_documents(docs, PATH).collect()}
    assert (spans[2].ids, spans[2].begins, spans[2].ends, spans[2].decoded) == ([2], [0], [0], "")
    assert b"".join(long.encode()[a:b] for a, b in zip(spans[5].begins, spans[5].ends)).decode() == long
    assert encode_digests(docs.limit(0), PATH).count() == 0
