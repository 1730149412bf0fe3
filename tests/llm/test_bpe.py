"""Ids and texts next to the tokenizers library."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablegauge.llm.bpe import PairIndexBpe, bpe_round_trip
from tablegauge.llm.queries import TOKENIZER

LIBRARY = Tokenizer.from_file(TOKENIZER)
OWN = PairIndexBpe(open(TOKENIZER, encoding="utf-8").read())
CASES = ["", " ", "aaaaaaaaa aaaa aaaaaaa", "Hello  world\n\n it's I'LL we'll\t\t x", "<|endoftext|>a<|endoftext|> b<|endoftext|>",
         "naïve café ß µ ² ½ 12³", "日本語 текст œuvre — “q”", "a\x1c\x85\xa0  b", "😀😀 é ՘ ꟎", "<|endof", "x" * 5000,
         "the " * 3000]


def check(texts):
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    packed = OWN.encode(texts)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == want
    assert [OWN.decode(p) for p in packed] == [LIBRARY.decode(w, skip_special_tokens=False) for w in want]


def test_cases():
    check(CASES)
    check(CASES)  # from the cache


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=4))
def test_any_text(texts):
    check(texts)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab 't\n", max_size=120))
def test_runs(text):
    check([text])


def test_documents(documents):
    rows = bpe_round_trip(documents, TOKENIZER, carry=["doc_id", "text"]).collect()
    assert len(rows) == documents.count()
    for r in rows:
        ids = LIBRARY.encode(r.row.text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.row.text.encode()).hexdigest()


def test_edges(make_docs):
    docs = make_docs([None, "", "a", "a"], {"ids": "1", "row": "'x'", "text.x": "2"})
    out = bpe_round_trip(docs, TOKENIZER).collect()
    assert [r.n_tokens for r in sorted(out, key=lambda r: r.row.doc_id)] == [0, 0, 1, 1]
    assert out[0].row.ids == 1 and out[0].row.row == "x"
    assert bpe_round_trip(docs.limit(0), TOKENIZER).count() == 0
