"""Encoding and decoding against the tokenizers library."""
import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelforge.llm.bpe import PairTree, bpe_encode, model_of, read_model

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
RAW = read_model(PATH)


def same(text):
    m = model_of(RAW)
    ids = m.encode(text)
    want = LIB.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert m.decode(ids) == LIB.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " ", "Hello  WORLD's it'll 12", "<|endoftext|>x<|startoftext|><|endoftext", "a\x85b​c\x1cd",
    "İΣΑΣ é ſ's ٣ Ⅷ \U0001f44d\U0001f3fd\x00", "x" * 5000, "ab" * 3000 + "'s", "!?" * 4000])
def test_cases(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text(text):
    same(text.encode("utf-8", "ignore").decode())


def test_tree_root_is_leftmost_lowest():
    rng = np.random.default_rng(1)
    keys = [int(r) * 50 + i for i, r in enumerate(rng.integers(0, 5, 37))]
    tree = PairTree(list(keys))
    while (top := tree.root()) < PairTree.INF:
        assert top == min(keys)
        i = top % 50
        keys[i] = PairTree.INF
        tree.put(i, PairTree.INF)


def test_operator_rows(spark):
    rows = [(1, "the cat", "z"), (1, "the cat", "z"), (2, None, None), (None, "", "q"), (3, "á " * 50, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe_encode(df, RAW).collect()
    assert len(out) == 5
    by = {(r.doc_id, r.n_tokens): r for r in out}
    want = LIB.encode("the cat", add_special_tokens=False).ids
    assert bytes(by[1, 2].ids) == np.array(want, "<u4").tobytes() and by[1, 2].decoded == "the</w> cat</w>"
    assert by[2, 0].decoded == "" and by[None, 0].n_tokens == 0 and by[3, 50].n_tokens == 50
    assert bpe_encode(df.limit(0), RAW).count() == 0


def test_query_matches_library(spark):
    from panelforge.llm.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op9_bpe"](spark, sf).collect():
        ids = LIB.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()
