import math

from pyspark.sql import functions as F

from panelforge.functions import hash_percent, pairwise_corr, sign_colour, smape_term


def test_corr_edge_cases(spark):
    # corr_edge fixture: constant series, one row, perfect line, NULL in x, NULL in y
    rows = ([("const", float(i), 5.0) for i in range(5)] + [("one", 1.0, 2.0)]
            + [("line", float(i), 3.0 * i + 1) for i in range(6)]
            + [("xnull", 1.0, 1.0), ("xnull", None, 9.0), ("xnull", 2.0, 2.0), ("xnull", 3.0, 3.5)]
            + [("ynull", 1.0, 1.0), ("ynull", 9.0, None), ("ynull", 2.0, 2.0), ("ynull", 3.0, 3.5)])
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = {r.g: (r.r, r.c) for r in df.groupBy("g").agg(pairwise_corr("x", "y").alias("r"))
           .select("g", "r", sign_colour("r").alias("c")).collect()}
    assert out["const"] == (None, "red")
    assert out["one"] == (None, "red")
    assert math.isclose(out["line"][0], 1.0, rel_tol=1e-12) and out["line"][1] == "green"
    # pairwise: the row with the NULL partner is ignored on both sides
    import numpy as np
    expect = np.corrcoef([1.0, 2.0, 3.0], [1.0, 2.0, 3.5])[0, 1]
    assert math.isclose(out["xnull"][0], expect, rel_tol=1e-12)
    assert math.isclose(out["ynull"][0], expect, rel_tol=1e-12)


def test_corr_shift_scale_invariant(spark):
    from hypothesis import given, settings, strategies as st
    import numpy as np

    @settings(max_examples=15, deadline=None)
    @given(st.lists(st.floats(-1e3, 1e3), min_size=3, max_size=20),
           st.floats(0.5, 10), st.floats(-100, 100))
    def check(ys, scale, shift):
        if np.ptp(ys) < 1e-6:
            return
        rows = [(float(i), y, float(i) * scale + shift) for i, y in enumerate(ys)]
        df = spark.createDataFrame(rows, "x double, y double, x2 double")
        r = df.agg(pairwise_corr("x", "y").alias("a"), pairwise_corr("x2", "y").alias("b")).first()
        assert math.isclose(r.a, r.b, rel_tol=1e-9, abs_tol=1e-9)
    check()


def test_smape_edges(spark):
    # smape_edge fixture: (0,0), (0,p), (y,0), negative y
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 3.0), (4.0, 0.0), (2.0, 2.0), (-1.0, 1.0)],
                               "y double, p double")
    vals = [r.e for r in df.select(smape_term("y", "p").alias("e")).collect()]
    assert vals[:4] == [0.0, 200.0, 200.0, 0.0]
    assert vals[4] == 0.0  # denominator (y + |p|) is 0 for y = -1, p = 1: guarded
    strict = df.select(smape_term("y", "p", strict=True).alias("e")).collect()[4].e
    assert strict == 200.0


def test_smape_range_nonnegative_targets(spark):
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=10, deadline=None)
    @given(st.lists(st.tuples(st.floats(0, 1e4), st.floats(-1e4, 1e4)), min_size=1, max_size=30))
    def check(pairs):
        df = spark.createDataFrame(pairs, "y double, p double")
        for r in df.select(smape_term("y", "p").alias("e")).collect():
            assert 0.0 <= r.e <= 200.0 + 1e-9
    check()


def test_hash_percent_partition_invariant(spark):
    df = spark.range(2000).select(F.col("id"))
    a = {r.id: r.b for r in df.select("id", hash_percent("id").alias("b")).collect()}
    b = {r.id: r.b for r in df.repartition(7).select("id", hash_percent("id").alias("b")).collect()}
    assert a == b
    share = sum(1 for v in a.values() if v < 70) / len(a)
    assert 0.65 < share < 0.75


def test_smape_subnormal_inputs_stay_in_range(spark):
    tiny = [(5e-324, 1e-323), (1e-310, 3e-310), (0.0, 5e-324), (2e-308, 1e-320)]
    df = spark.createDataFrame(tiny, "y double, p double")
    for r in df.select(smape_term("y", "p").alias("e")).collect():
        assert 0.0 <= r.e <= 200.0
