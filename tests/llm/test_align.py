"""Tokenizer alignment against a plain loop over tokens."""
import collections
import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelforge.llm.align import (B_IDS, ByteTokens, PieceTokens, Side, align_texts, alignment, same_bytes,
                                  segmented_ends, sides)
from panelforge.llm.bpe import byte_symbols, read_model

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIB_A = Tokenizer.from_file(A)
LIB_A.encode_special_tokens = True
LIB_B = sentencepiece.SentencePieceProcessor(model_file=B)
BYTE = {s: b for b, s in enumerate(byte_symbols())}
SPECIAL = {i: t.content.encode() for i, t in LIB_A.get_added_tokens_decoder().items()}


def byte_a(i):
    return SPECIAL.get(i) or bytes(BYTE[c] for c in LIB_A.id_to_token(i))


def byte_b(i):
    p = LIB_B.id_to_piece(i)
    return bytes([int(p[3:-1], 16)]) if LIB_B.is_byte(i) else p.replace("▁", " ").encode()


def spans(ids, of):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(of(i))))
        at += len(of(i))
    return out


def plain(texts):
    """Per text: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    docs, count = [], collections.Counter()
    for t in texts:
        a = spans(LIB_A.encode(" " + t, add_special_tokens=False).ids, byte_a) if t else []
        b = spans(LIB_B.encode(t), byte_b) if t else []
        if any(b"".join(of(i) for i, _, _ in x) != (" " + (t or "")).encode() for x, of in ((a, byte_a), (b, byte_b))):
            a, b = [], []
        links, j = [], 0
        for i, s, e in a:
            while j and b[j][1] > s:
                j -= 1
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        count.update(links)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, lo = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in x if lo <= s and e <= c) for x in (a, b)))
            lo = c
        docs.append((len(a), len(b), links, ";".join(groups), len(groups)))
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    rows = [(na, nb, ng, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for na, nb, links, g, ng in docs]
    return rows, count


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = ["the cat sat on the mat", "the cat sat on the mat", None, "", " ", "  two  spaces ", "tab\there\n\nline",
         "é ñ 漢字 \U0001f600 ½ ﬁ", "<|endoftext|> <s> </s> <0x41> ▁", "don't we'll I'M 2024", "naïve Ａ　b\x00c",
         "x" * 3000, "word " * 4000, "á é"]


@pytest.mark.parametrize("heavy", [1_000_000, 20, 0])
def test_against_plain_loop(spark, heavy):
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(TEXTS)],
                               "doc_id long, text string, pair string, n int").repartition(3)
    out, pairs = alignment(df, A, B, heavy_pairs=heavy)
    want, count = plain(TEXTS)
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in out.collect()}
    assert [got[i] for i in range(len(TEXTS))] == want
    assert {(r.a_id, r.b_id): r.n for r in pairs.collect()} == dict(count)


def test_query_against_plain_loop(spark):
    from panelforge.llm.catalog import QUERIES
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want, _ = plain([r.text for r in docs])
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in QUERIES["op11_alignment"](spark, SF).collect()}
    assert [got[r.doc_id] for r in docs] == want


def test_bytes_above_127_are_given_back():
    side = Side(PieceTokens(read_model(B)), ";")
    texts = ["plain", "é", "漢字 naïve", "ß", ""]
    ids = pa.array(side.encode(texts), pa.list_(pa.int32()))
    flat, _, _, size = segmented_ends(ids, side.lengths)
    want = [(" " + t).encode() if t else b"" for t in texts]
    assert same_bytes(side, flat, size, want).tolist() == [True] * len(texts)
    assert same_bytes(side, flat, size, [w[:-1] + b"\xff" for w in want]).tolist() == [False] * len(texts)
    assert align_texts(["é ñ"], *sides(read_model(A), read_model(B)))["n_a"][0] > 0


def test_ids_of_both_libraries():
    a, b = ByteTokens(read_model(A)), PieceTokens(read_model(B))
    assert len(a.bytes) < B_IDS and len(b.bytes) < B_IDS
    texts = [t or "" for t in TEXTS] + ["  \n \t x'S 'll    y z", "١٢٣ Ⅷ", "q" * 70000]
    for t, ids in zip(texts, a.encode(texts)):
        assert ids == LIB_A.encode(" " + t, add_special_tokens=False).ids
        assert b"".join(a.bytes[i] for i in ids) == (" " + t).encode()
    assert b.encode(texts) == [LIB_B.encode(t) for t in texts]


def test_edges(spark):
    schema = "doc_id string, text string"
    assert alignment(spark.createDataFrame([], schema), A, B)[0].count() == 0
    rows = alignment(spark.createDataFrame([(None, "a b"), ("k", "a b"), ("k", "a b")], schema), A, B)[0].collect()
    assert len(rows) == 3 and len({tuple(r[c] for c in COLS) for r in rows}) == 1 and rows[0].count_sum == 6
