import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_ORACLE
from panelforge.operators import joins, ml
from panelforge.operators import windows as win
from panelforge.plans import fixtures as fx


def test_panel_shape_and_partitioning(spark):
    p = fx.panel(spark, SF_ORACLE)
    prof = p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("series").alias("s"),
                 F.count_distinct("t").alias("m"), F.max("t").alias("hi")).first()
    assert (prof.n, prof.s, prof.m) == (8300, 100, 83)
    assert prof.hi == dt.date(2001, 11, 1)
    # every (series, t) exactly once
    assert p.groupBy("series", "t").count().where("count > 1").count() == 0
    # per-series windows need no shuffle on the fixture
    plan = win.rolling_stats(p)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_late_and_future_panels(spark):
    late = fx.late_panel(spark, SF_ORACLE)
    assert "active" not in late.columns
    assert late.select("t").distinct().count() == 4 and late.count() == 400
    fut = fx.future_panel(spark, SF_ORACLE)
    ts = sorted(r.t for r in fut.select("t").distinct().collect())
    assert ts == [dt.date(2001, 12, 1), dt.date(2002, 1, 1), dt.date(2002, 2, 1), dt.date(2002, 3, 1)]
    assert fut.count() == 400


def test_attributes_have_null_supplier_balance(spark):
    a = fx.attributes(spark, SF_ORACLE)
    assert a.where("avg_funded_bal IS NULL").count() > 0
    # every supplier and every line is in the fixtures
    tables = {n: spark.read.parquet(f"{SF_ORACLE}/{n}.parquet").count() for n in ("supplier", "lineitem")}
    assert a.count() == tables["supplier"] == 100
    assert fx.panel(spark, SF_ORACLE).agg(F.sum("active")).first()[0] == tables["lineitem"]
    shares = a.select((F.col("share_automobile") + F.col("share_building") + F.col("share_furniture")
                       + F.col("share_household") + F.col("share_machinery")).alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-9 for r in shares)


def test_appended_panel_equals_the_panel(spark):
    p, a = fx.panel(spark, SF_ORACLE), fx.appended(spark, SF_ORACLE)
    cols = ["series", "county", "state", "t", "density"]
    assert a.count() == p.count() and a.select(cols).exceptAll(p.select(cols)).count() == 0
    assert a.where("active IS NULL").count() == 400
    plan = win.rolling_stats(a)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_panel_spreads_over_partitions_as_series_grow(spark):
    big = SF_ORACLE.replace("0.01", "0.1")
    assert fx.panel_partitions(spark, SF_ORACLE, 83) == 1
    assert fx.panel_partitions(spark, big, 83) > 1


def test_attach_ids_keeps_unknown_keys(spark):
    ids = spark.createDataFrame([(1, 0), (2, 1)], "k int, id int")
    df = spark.createDataFrame([(1,), (3,), (None,)], "k int")
    got = {r.k: r.id for r in joins.attach_ids(df, ids, "k").collect()}
    assert got == {1: 0, 3: None, None: None}


def test_global_rank_deterministic_with_duplicates(spark):
    rows = [(i % 37, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(6)
    r1 = sorted((r.k, r.rk) for r in win.global_rank(df, "k", "rk").collect())
    ranks = sorted(rk for _, rk in r1)
    assert ranks == list(range(600))
    # ranks respect key order
    by_key = {}
    for k, rk in r1:
        by_key.setdefault(k, []).append(rk)
    keys = sorted(by_key)
    for a, b in zip(keys, keys[1:]):
        assert max(by_key[a]) < min(by_key[b])


def test_bounded_broadcast_respects_bound(spark):
    small = spark.range(10)
    big = spark.range(100)
    assert "ResolvedHint" in small.join(joins.bounded_broadcast(small, 50), "id")._jdf.queryExecution().analyzed().toString() \
        or "broadcast" in small.join(joins.bounded_broadcast(small, 50), "id")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert joins.bounded_broadcast(big, 50) is big


def test_cross_validate_small(spark):
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(2 * a + 0.1 * rng.normal())) for i, a in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    lr = LinearRegression(labelCol="y", featuresCol="features")
    from pyspark.ml.tuning import ParamGridBuilder
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 10.0]).build()
    out = ml.cross_validate(df, lr, grid, ["x"], "y", folds=2, split_keys=["id"]).collect()
    assert len(out) == 2 and sum(r.best for r in out) == 1
    best = [r for r in out if r.best][0]
    assert best.regParam == 0.0 and best.holdout_rmse < 0.2


def test_gbt_early_stop_stops(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(np.sin(a) + 0.05 * rng.normal()))
            for i, a in enumerate(rng.uniform(-3, 3, size=600))]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    tr, va = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    model, _ = ml.gbt_early_stop(tr, va, ["x"], "y", max_iter=60, tol=0.01)
    assert 1 <= model.getNumTrees < 60


def test_last_dates_skip_and_take(spark):
    from helpers import months
    rows = [(1, t, 1.0) for t in months(10)]
    df = spark.createDataFrame(rows, "series int, t date, density double")
    got = sorted(r.t for r in win.last_dates(df, 3, skip=2).collect())
    assert got == months(10)[5:8]


def test_cluster_conf_scales_partitions():
    from panelforge.session import cluster_conf
    small = cluster_conf(16, input_tb=0.001)
    big = cluster_conf(8000, input_tb=100)
    assert int(small["spark.sql.shuffle.partitions"]) == 48
    assert int(big["spark.sql.shuffle.partitions"]) >= 3 * 8000
    assert big["spark.sql.adaptive.coalescePartitions.enabled"] == "true"
