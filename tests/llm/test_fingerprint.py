"""Winnowing fingerprints against brute force."""
import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from panelforge.llm.fingerprint import K, POS_BITS, W, edited_fingerprints, fingerprint_text, winnow

SF = "/root/testdata/sf0.001"


def brute(text, k=K, w=W):
    """(position, hash) chosen by looking at every window."""
    if not text:
        return []
    raw, bits = text.encode("utf-32-be"), 64 - POS_BITS
    hashes = [xxhash.xxh64_intdigest(raw[4 * i:4 * (i + k)], seed=42) % (1 << bits)
              for i in range(max(1, len(text) - k + 1))]
    signed = [h - (1 << bits) if h >> (bits - 1) else h for h in hashes]
    chosen = set()
    for s in range(max(1, len(hashes) - w + 1)):
        window = range(s, min(s + w, len(hashes)))
        least = min(signed[i] for i in window)
        chosen.add(max(i for i in window if signed[i] == least))
    return [(i, hashes[i]) for i in sorted(chosen)]


def jaccard(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(docs):
    """Result rows of (id, text) documents with distinct ids in order."""
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is not None, d[0]))
    for n, (i, t) in enumerate(docs):
        nxt, half = docs[(n + 1) % len(docs)][1], len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, b = brute(t), brute(edited)
        yield i, (len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, jaccard(a, b), jaccard(a, brute(nxt)))


def listed(fp):
    return ",".join(f"{p}:{h:x}" for p, h in fp)


@pytest.mark.parametrize("k,w,piece", [(20, 80, 800), (3, 4, 7), (5, 1, 10), (1, 8, 16), (4, 16, 1)])
def test_places_of_every_window(spark, k, w, piece):
    rng = random.Random(1)
    texts = ["", "a", "é" * 5, "a" * 300, "ab" * 200] + [
        "".join(rng.choice("abc d\U0001f600") for _ in range(rng.randint(1, 900))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id int, t string")
    for r in df.select("t", winnow(F.col("t"), k, w, piece).alias("f")).collect():
        assert [(x.pos, x.hash) for x in r.f] == brute(r.t, k, w)


def test_shared_passage_is_found(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(20))[:K + W - 1]
    a, b = (f"{' '.join(word() for _ in range(n))} {passage} {' '.join(word() for _ in range(n))}" for n in (50, 211))
    fa, fb = (dict((h, p) for p, h in [(x.pos, x.hash) for x in r.f]) for r in spark.createDataFrame(
        [(0, a), (1, b)], "i int, t string").orderBy("i").select(winnow(F.col("t")).alias("f")).collect())
    at = a.index(passage), b.index(passage)
    assert any(fa[h] - at[0] == fb[h] - at[1] and 0 <= fa[h] - at[0] <= W - 1 for h in fa.keys() & fb.keys())


def test_query_matches_brute_force(spark):
    from panelforge.llm.catalog import QUERIES
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = dict(expected(docs))
    out = QUERIES["op13_fingerprint"](spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(want)
    for r in out:
        n, sha, a, b, near_edited, near_next = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, sha, listed(a), listed(b))
        assert r.near_edited == pytest.approx(near_edited) and r.near_next == pytest.approx(near_next)


def test_edges(spark):
    long = " ".join(f"w{i * 7919 % 1000}" for i in range(30000))
    docs = [(None, "no id"), (1, "same text " * 40), (2, None), (3, ""), (4, long), (5, "same text " * 40), (6, "x")]
    rows = [(i, t, "z", 7, "c") for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string, id int, bucket string")
    out = edited_fingerprints(df.repartition(3)).collect()
    want = dict(expected(docs))
    assert len(out) == len(docs)
    for r in out:
        n, sha, a, b, near_edited, near_next = want[r.doc_id]
        assert hashlib.sha256(r.edited.encode()).hexdigest() == sha and list(zip(r.pos, r.hash)) == a
        assert list(zip(r.edited_pos, r.edited_hash)) == b and (r.near_edited, r.near_next) == (near_edited, near_next)
    assert edited_fingerprints(df.limit(0)).count() == 0
    alone = edited_fingerprints(df.where("doc_id = 1")).first()
    assert alone.near_next == 1.0 and alone.edited == "same text " * 40


def test_repeated_rows_and_equal_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "bb"), (2, "ccc")], "doc_id long, text string")
    out = sorted((r.doc_id, r.text, r.edited, r.fp) for r in edited_fingerprints(df).select(
        "*", fingerprint_text(F.col("pos"), F.col("hash")).alias("fp")).collect())
    assert [(i, t) for i, t, _, _ in out] == [(1, "a"), (1, "a"), (1, "bb"), (2, "ccc")]
    assert out[0] == out[1]
    # documents of one id follow each other by hash: one of "a" and "bb" is before "ccc"
    first = min("a", "bb", key=lambda t: xxhash.xxh64_intdigest(t, seed=42) - (
        1 << 64 if xxhash.xxh64_intdigest(t, seed=42) >> 63 else 0))
    assert {t: e for _, t, e, _ in out}["ccc"] == "cc" + first[:1]
