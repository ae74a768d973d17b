import base64
import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricemill.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_RANKS), reason="no vocabulary")
ODD = ["", " ", "  ", "a  b", " a", "a ", "\n\n x", "a \n b", "it's DON'T", "x" * 5000, "日本語 " * 40, "a b", "\x85 a", " \x1cb", "👩‍⚖️ 判決", "1 234 567,89 грн", "<|endoftext|>", "a​ b", "é é", " " * 300 + "z", "﻿x"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(bpe.DEFAULT_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts):
    import numpy as np

    ids, n = bpe.encode_batch(bpe.DEFAULT_RANKS, pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_odd_texts(library):
    assert encode(ODD) == [library.encode_ordinary(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'sтіß 　.,1"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=4))
def test_any_text(library, texts):
    assert encode(texts) == [library.encode_ordinary(t) for t in texts]


def test_table(spark, library):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (2, None, 7), (3, "", 8), (None, "x", 9)], "doc_id long, text string, ids long")
    got = sorted([(r.doc_id or 0, r.ids) for r in bpe.encode_corpus(df).collect()])
    ab = library.encode_ordinary("a b")
    assert got == sorted([(1, ab), (1, ab), (2, []), (3, []), (0, library.encode_ordinary("x"))])
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, ["doc_id"]).collect()} == {1: 2, 2: 0, 3: 0, None: 1}


def test_round_trip(spark, sf):
    import __spark_entry__ as e

    with open(bpe.DEFAULT_RANKS, "rb") as f:
        back = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in e.queries()["p8_ids"](spark, sf).collect():
        assert b"".join(back[i] for i in r.ids).decode() == (texts[r.doc_id] or "")


def test_shared_prefixes_are_encoded_once(library):
    enc = bpe.PrefixEncoder(bpe.encoder(bpe.DEFAULT_RANKS).ranks)
    words = [w.encode() for w in ("token", "tokens", "tokenizer", "tokenizers", "to", "грн", "гривня")]
    assert enc.encode_words(words) == {w: library.encode_ordinary(w.decode()) for w in words}


def test_store_is_bounded_by_bytes(monkeypatch):
    """Long texts without blanks are chunks of their own: the store starts anew by their bytes, and ids stay the same."""
    import pyarrow as pa

    from pricemill.llm import bpe

    texts = [f"слово{i}" * 4000 + f" and {i}" for i in range(12)] + ["", "plain words"]
    one = [bpe.encode_batch(bpe.DEFAULT_RANKS, pa.array([t]))[0].tolist() for t in texts]
    monkeypatch.setattr(bpe, "KEEP_BYTES", 300_000)
    store = bpe._store(bpe.DEFAULT_RANKS)
    store.clear()
    most = 0
    for t, want in zip(texts, one):
        assert bpe.encode_batch(bpe.DEFAULT_RANKS, pa.array([t]))[0].tolist() == want
        most = max(most, store.held)
    assert 300_000 < most < 900_000
    store.clear()
