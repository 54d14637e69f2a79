import hashlib
import struct

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from testweave.llm.bpe import encode_digests, encode_documents, loaded

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [None, "", "a", " ", "   \n\n  x \t\t y  ", "Hello world's they'll we're", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "naïve Straße 東京 \U0001f600 é́", "x" * 5000, "abcdefghij" * 700, "\x1c\x1d a\x85b c​d　e", "1234567 $$$*** |--|", "\x00\x01�", "ab " * 4000]


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab thein'sre \n\tAZé<|>", max_size=120))
def test_equals_the_library(text):
    assert struct.unpack(f"<{len(loaded(PATH).encode(text)) // 4}I", loaded(PATH).encode(text)) == tuple(expected(text))


def test_documents(spark):
    rows = [(i, t, "a", "b") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None), (None, "null id", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.decoded) for r in encode_documents(docs, PATH).collect())
    want = sorted((i is None, i or 0, struct.pack(f"<{len(e)}I", *e), LIBRARY.decode(e, skip_special_tokens=False)) for i, t, *_ in rows for e in [expected(t)])
    assert got == want
    digests = {r.doc_id: r for r in encode_digests(docs, PATH).collect()}
    for i, t, *_ in rows:
        e = expected(t)
        assert digests[i].n_tokens == len(e)
        assert digests[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode_digests(docs.limit(0), PATH).count() == 0
