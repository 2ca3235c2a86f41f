"""Hard negatives against brute force and Strassen's product against numpy."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import negatives
from panelforge.llm.negatives import Heaps, best_of, hard_negatives, strassen


def brute(rows, every, k=5, scale=256, low=80, high=100):
    """Result rows of (id, label, vector) rows, with unbounded integers."""
    ok = {(i, l, tuple(v)) for i, l, v in rows
          if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    ok = [(i, l, [int(x) * scale if abs(x) >= 1 << 52 else math.floor(x * scale) for x in v]) for i, l, v in ok]
    out = set()
    for i, l, v in ok:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in ok]
        best = sorted((s, j) for s, j, m in scored if m == l and j != i)[:k]
        for s, j in best:
            near = sorted((t, n) for t, n, m in scored if m != l and low * -s <= high * -t <= high * -s)[:k]
            out |= {(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(near)}
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("m,k,n", [(1, 1, 1), (5, 7, 3), (33, 64, 100), (70, 33, 71), (256, 64, 300)])
def test_strassen(m, k, n):
    rng = np.random.default_rng(m)
    a, b = rng.integers(-300, 300, (m, k)), rng.integers(-300, 300, (k, n))
    for leaf in (1, 2, 8, 64):
        assert (strassen(a, b, leaf) == a @ b).all()
    big, small = rng.integers(-2**40, 2**40, (m, k)), rng.integers(-2**15, 2**15, (k, n))
    assert (strassen(big, small, 2) == big @ small).all()
    assert (strassen(big.astype(object) << 60, small.astype(object), 4) == (big.astype(object) << 60) @ small).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(3)
    score, fits = rng.integers(-3, 4, (6, 40)), rng.random((6, 40)) < .6
    for order in ([0, 10, 20, 30], [30, 0, 20, 10]):
        heap = Heaps(6, 4, np.int64)
        for j in order:
            heap.merge(*best_of(score[:, j:j + 10], fits[:, j:j + 10], j, 4))
        for r in range(6):
            want = sorted((-score[r, c], c) for c in range(40) if fits[r, c])[:4]
            assert [(-s, c) for s, c, v in zip(heap.score[r], heap.place[r], heap.valid[r]) if v] == want


def vectors(rng, n, dim, labels):
    base = rng.normal(size=(4, dim))
    return [(i, int(rng.integers(labels)), [float(x) for x in np.round(base[i % 4] + rng.normal(size=dim) * .3, 1)])
            for i in range(n)]


def test_blocks_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = vectors(rng, 400, 9, 3)
    rows += [(1000 + i, 0, rows[0][2]) for i in range(40)]           # equal vectors of one label
    rows += [(2000 + i, 1 + i % 2, rows[0][2]) for i in range(40)]   # and of others
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    want = brute(rows, 20)
    assert want and found(hard_negatives(df, lambda i: i % 20 == 0)) == want
    for name, value in (("BLOCK", 64), ("ANCHOR_BLOCK", 7), ("TILE", 10), ("ANCHOR_TILE", 3)):
        monkeypatch.setattr(negatives, name, value)
    assert found(hard_negatives(df, lambda i: i % 20 == 0)) == want


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (1, 1, [1.0]), (2, 2, [1.0, 2.0]), (3, 2, []), (4, None, [1.0, 1.0]),
            (5, 2, None), (6, 2, [1.0, None]), (7, 2, [inf, 1.0]), (8, 2, [nan, 1.0]), (None, 2, [1.0, 2.0]),
            (9, 2, [0.95, -0.001]), (10, 3, [-1.0, -1.0]), (20, 3, [1.0, 1.0])]
    schema = "vec_id long, label int, embedding array<double>, id int, score string, vec string"
    df = spark.createDataFrame([r + (1, "s", "v") for r in rows], schema)
    want = brute(rows, 10)
    assert want and found(hard_negatives(df, lambda i: i % 10 == 0)) == want
    assert found(hard_negatives(df.limit(0), lambda i: i % 10 == 0)) == set()
    assert found(hard_negatives(df.where("vec_id = 0"), lambda i: i % 10 == 0)) == set()


def test_large_components(spark):
    # scores fit 64 bits, their hundredfold and the intermediate sums do not
    rows = [(0, 1, [2.0**22, 2.0**22]), (1, 1, [2.0**22, 1.0]), (2, 2, [2.0**22 - 5, 3.0]), (3, 2, [2.0**22 - 9, 1.0]),
            (4, 2, [-2.0**22, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = brute(rows, 10)
    assert want and found(hard_negatives(df, lambda i: i % 10 == 0)) == want


def test_text_ids_and_labels(spark):
    rng = np.random.default_rng(8)
    rows = vectors(rng, 60, 4, 2)
    df = spark.createDataFrame([(f"v{i:03d}", f"L{l}", v) for i, l, v in rows], "k string, tag string, e array<double>")
    got = found(hard_negatives(df, lambda i: F.substring(i, 4, 1) == "0", id_col="k", label_col="tag", vec_col="e"))
    assert got == {(f"v{a:03d}", f"v{p:03d}", r, f"v{n:03d}", s, t) for a, p, r, n, s, t in brute(rows, 10)}


def test_query_against_brute_force(spark):
    from panelforge.llm.catalog import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(QUERIES["op12_hard_negatives"](spark, sf)) == brute(rows, 100)
