import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.operators import aggregates as agg
from panelforge.operators import columns as cols
from panelforge.operators import joins


def test_cast_columns_try_cast_and_zip(spark):
    df = spark.createDataFrame([("1", "2.5", "2020-01-01"), ("x", "bad", "2020-13-01")],
                               "a string, b string, c string")
    out = cols.cast_columns(df, ["a", "b", "c"], ["int", "double"])  # c ignored (zip)
    rows = out.collect()
    assert rows[0].a == 1 and rows[0].b == 2.5 and rows[0].c == "2020-01-01"
    assert rows[1].a is None and rows[1].b is None
    assert dict(out.dtypes)["c"] == "string"
    with pytest.raises(Exception):
        cols.cast_columns(df, ["a"], ["int"], strict=True).collect()


def test_drop_columns_ignores_unknown(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert cols.drop_columns(df, ["b", "nope"]).columns == ["a", "c"]


def test_complete_rows_after_cast(spark):
    df = spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c")], "v string, k string")
    out = cols.complete_rows(cols.cast_columns(df, ["v"], ["int"]))
    assert [r.k for r in out.collect()] == ["a"]


def test_date_parts_malformed(spark):
    df = spark.createDataFrame([("2021-03-01",), ("03/01/2021",)], "s string")
    rows = cols.date_parts(df, "s").collect()
    assert rows[0].date == dt.date(2021, 3, 1) and (rows[0].year, rows[0].month, rows[0].day) == (2021, 3, 1)
    assert rows[1].date is None and rows[1].year is None


def test_keys_fixture_joins(spark):
    # keys fixture: key only left, only right, duplicated, malformed text
    panel = spark.createDataFrame([("1", 1.0), ("1", 2.0), ("2", 3.0), ("x", 4.0)], "series string, y double")
    attrs = spark.createDataFrame([(1, 10.0), (3, 30.0)], "series int, a double")
    panel = joins.harmonize_key(panel, "series")
    assert sorted(r.series for r in joins.common_keys(attrs, panel).collect()) == [1]
    j = joins.panel_attr_join(panel, attrs)
    assert sorted((r.series, r.y) for r in j.collect()) == [(1, 1.0), (1, 2.0)]  # 1:N kept
    cov = agg.key_coverage(panel, attrs).first()
    assert (cov.panel_keys, cov.attr_keys, cov.common_keys) == (2, 2, 1)


def test_dense_ids_sorted_across_partitions(spark):
    names = [f"k{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "k string").repartition(5)
    ids = {r.k: r.kid for r in joins.dense_ids(df, "k", "kid").collect()}
    assert ids == {n: i for i, n in enumerate(names)}
    missing = joins.missing_keys(spark.createDataFrame([("k0001",), ("zz",)], "k string"),
                                 joins.dense_ids(df, "k", "kid"), "k")
    assert [r.k for r in missing.collect()] == ["zz"]


def test_append_by_name(spark):
    a = spark.createDataFrame([(1, 2, 3.0)], "series int, active int, density double")
    b = spark.createDataFrame([(4.0, 1)], "density double, series int")
    rows = joins.append_panel(a, b).collect()
    assert len(rows) == 2 and rows[1].active is None and rows[1].series == 1


def test_null_profile_same_name(spark):
    # same_name fixture: one county name in two states, NULLs in both
    df = spark.createDataFrame([("A", "S1", None), ("A", "S1", 1.0), ("A", "S2", None), ("B", "S1", 2.0)],
                               "county string, state string, v double")
    out = sorted((r.county, r.state, r.n_nulls) for r in agg.null_profile(df, "v").collect())
    assert out == [("A", "S1", 1), ("A", "S2", 1)]


def test_group_sizes_ties(spark):
    # ties fixture: equal counts are ordered by key
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (3, "c")], "series int, state string")
    out = [(r.state, r.n_rows, r.n_series) for r in agg.group_sizes(df).collect()]
    assert out == [("c", 2, 1), ("a", 1, 1), ("b", 1, 1)]


def test_ranked_corr_ties_and_exact_n(spark):
    from helpers import months
    ts = months(6)
    rows = []
    for s, slope in [(1, 1.0), (2, 1.0), (3, -1.0), (4, 0.5)]:
        for i, t in enumerate(ts):
            rows.append((s, f"c{s}", "st", t, slope * i + (0.1 * (i % 2) if s == 4 else 0.0)))
    df = spark.createDataFrame(rows, "series int, county string, state string, t date, density double")
    top = agg.ranked_corr_series(df, 2)
    got = sorted({(r["rank"], r.series) for r in top.collect()})
    assert got == [(1, 1), (2, 2)]  # equal correlation: tie broken by key
    assert top.count() == 2 * len(ts)


def test_stream_append_exactly_once(spark):
    import os
    from panelforge.session import scratch_path
    from panelforge.streaming import ingest_late, panel_with_late
    from helpers import months
    schema = "series int, county string, state string, t date, density double"
    base = spark.createDataFrame([(1, "a", "s", months(1)[0], 1.0)], schema).withColumn("active", F.lit(3))
    src, sink, ck = (scratch_path(spark, n) for n in ("src", "sink", "ck"))
    spark.createDataFrame([(1, "a", "s", months(2)[1], 2.0)], schema).write.parquet(os.path.join(src, "f1"))
    ingest_late(spark, src + "/*", sink, ck)
    ingest_late(spark, src + "/*", sink, ck)  # rerun: nothing new, no duplicates
    assert panel_with_late(spark, base, sink).count() == 2
    spark.createDataFrame([(1, "a", "s", months(3)[2], 3.0)], schema).write.parquet(os.path.join(src, "f2"))
    ingest_late(spark, src + "/*", sink, ck)
    out = panel_with_late(spark, base, sink)
    assert out.count() == 3 and out.where("active IS NULL").count() == 2
