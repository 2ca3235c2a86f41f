import math

import numpy as np
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from helpers import months
from panelforge.operators import forecast as fc
from panelforge.operators import ml
from panelforge.operators import windows as win


def _panel(spark, series_values, state="S"):
    rows = [(s, state if isinstance(state, str) else state[s], t, float(v))
            for s, vals in series_values.items() for t, v in zip(months(len(vals)), vals)]
    return spark.createDataFrame(rows, "series int, state string, t date, density double")


def test_persistence_and_seasonal_naive(spark):
    vals = {1: list(range(1, 25)), 2: [5.0] * 24}
    p = _panel(spark, vals)
    per = fc.persistence_forecast(p).orderBy("series", "h").collect()
    assert [(r.series, r.h, r.p, r.y) for r in per[:4]] == [(1, h, 20.0, 20.0 + h) for h in range(1, 5)]
    sn = fc.seasonal_naive_forecast(p).where("series = 1").orderBy("h").collect()
    assert [r.p for r in sn] == [9.0, 10.0, 11.0, 12.0]
    sm = {r.series: r.smape for r in fc.smape_by(fc.persistence_forecast(p), ["series"]).collect()}
    assert sm[2] == 0.0 and sm[1] > 0


def test_select_model_tie_uses_order(spark):
    rows = [("b", 1, "S", None, 1, 1.0, 1.0), ("a", 1, "S", None, 1, 1.0, 1.0)]
    pred = spark.createDataFrame(rows, "model string, series int, state string, t date, h int, y double, p double")
    out = {r.model: r["rank"] for r in fc.select_model(pred, ["b", "a"]).collect()}
    assert out == {"b": 1, "a": 2}


def test_smape_by_horizon(spark):
    rows = [("m", 1, "S", None, h, 1.0, 1.0 if h == 1 else 3.0) for h in range(1, 5)]
    pred = spark.createDataFrame(rows, "model string, series int, state string, t date, h int, y double, p double")
    r = fc.smape_by_horizon(pred).first()
    assert r.public == 0.0 and math.isclose(r.private, 100.0)


def test_hash_split_partition_invariant(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    a = {r.k: r.split for r in ml.hash_split(df, ["k", "v"]).collect()}
    b = {r.k: r.split for r in ml.hash_split(df.repartition(3), ["k", "v"]).collect()}
    assert a == b


def test_standardize_constant_column(spark):
    # const_feature fixture: a constant column and a NULL cell
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0), (3, 6.0, 5.0), (4, None, 5.0)],
                               "id int, a double, c double")
    out = ml.standardize(df, ["a", "c"]).orderBy("id").collect()
    assert len(out) == 3  # NULL row skipped by the assembler
    assert [r.z_c for r in out] == [0.0, 0.0, 0.0]
    assert np.allclose([r.z_a for r in out], [-1.0, 0.0, 1.0])


def test_importances_sum_to_one(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), float(3 * a + rng.normal())) for i, (a, b) in
            enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    imp = ml.feature_importance(df, ["a", "b"], "y", num_trees=10, max_depth=3, layout_keys=["id"])
    vals = {r.feature: r.importance for r in imp.collect()}
    assert math.isclose(sum(vals.values()), 1.0, rel_tol=1e-9) and vals["a"] > vals["b"]


def test_label_never_a_feature(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, y double")
    try:
        ml.feature_importance(df, ["a", "y"], "y")
    except ValueError:
        return
    raise AssertionError("label accepted as a feature")


def test_pca_scree_properties(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], "a double, b double, c double, d double, e double")
    out = ml.pca_scree(df, features=list("abcde"), k=9).orderBy("k").toPandas()
    assert len(out) == 5
    assert (np.diff(out.cumulative) >= -1e-12).all() and out.cumulative.iloc[-1] <= 1 + 1e-9
    cov = np.cov(X, rowvar=False)
    ev = np.sort(np.linalg.eigvalsh(cov))[::-1]
    np.testing.assert_allclose(out.explained, ev / ev.sum(), atol=1e-9)


def test_linear_regression_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=100)
    rows = [(float(a), float(2.5 * a - 1 + 0.1 * rng.normal())) for a in x]
    df = spark.createDataFrame(rows, "x double, y double")
    m = LinearRegression(featuresCol="features", labelCol="y").fit(ml.assemble(df, ["x"]))
    r = df.selectExpr("regr_slope(y, x) AS b", "regr_intercept(y, x) AS a").first()
    assert math.isclose(m.coefficients[0], r.b, rel_tol=1e-6)
    assert math.isclose(m.intercept, r.a, rel_tol=1e-6, abs_tol=1e-9)


def test_smape_evaluator_and_random_search(spark):
    ev = ml.SmapeEvaluator(labelCol="y", predictionCol="p")
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 3.0)], "y double, p double")
    assert math.isclose(ev.evaluate(df), 50.0) and not ev.isLargerBetter()
    lr = LinearRegression(featuresCol="features", labelCol="y")
    maps = ml.sample_param_maps(lr, {"regParam": ("log", 1e-4, 1e-1), "fitIntercept": [True, False]}, 4, seed=7)
    again = ml.sample_param_maps(lr, {"regParam": ("log", 1e-4, 1e-1), "fitIntercept": [True, False]}, 4, seed=7)
    assert len(maps) == 4 and [sorted((p.name, v) for p, v in m.items()) for m in maps] == \
        [sorted((p.name, v) for p, v in m.items()) for m in again]


def test_recursive_forecast_shifts_state(spark):
    vals = {s: [float(i + s) for i in range(30)] for s in range(3)}
    p = _panel(spark, vals)
    w = ml.flatten_windows(win.sequence_windows(p, extra=("state",)))
    model = ml.pooled_ar_pipeline("linear").fit(w)
    state = spark.createDataFrame([(s, "S", [float(i + s) for i in range(22, 30)]) for s in range(3)],
                                  "series int, state string, x array<double>")
    hz = spark.createDataFrame([(h, None) for h in range(1, 5)], "h int, t date")
    out = ml.recursive_forecast(model, state, hz, 4).orderBy("series", "h").collect()
    assert len(out) == 12
    # a linear trend is continued step by step
    assert np.allclose([r.p for r in out if r.series == 0], [30.0, 31.0, 32.0, 33.0], atol=1e-3)


def test_standardize_matches_ml_scaler(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)) * [3, 7] + [1, -2])]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    native = {r.id: (r.z_a, r.z_b) for r in ml.standardize(df, ["a", "b"]).collect()}
    _, scaled = ml.standard_scaler(df, ["a", "b"])
    for r in scaled.select("id", "scaled").collect():
        assert np.allclose(native[r.id], r.scaled.toArray(), atol=1e-10)


def test_series_encoding_feeds_trees(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(4):
        for i in range(20):
            x = [float(100 + 50 * s + v) for v in rng.normal(size=8)]
            # two series share one county name
            rows.append((s, f"c{s // 2}", "S" if s < 2 else "T", x, float(100 + 50 * s)))
    df = spark.createDataFrame(rows, "series int, county string, state string, x array<double>, target double")
    w = ml.add_series_encoding(ml.flatten_windows(df), df)
    enc = {r.series: r.series_te for r in w.select("series", "series_te").distinct().collect()}
    assert all(math.isclose(enc[s], (20 * (100 + 50 * s) + 175) / 21) for s in range(4))
    for kind in ("rf", "gbt"):
        model = ml.pooled_ar_pipeline(kind, series_col="series_te").fit(w)
        assert model.transform(w).count() == 80
    # an unknown series and a NULL key get the overall mean
    new = spark.createDataFrame([(9,), (None,)], "series int")
    assert [r.series_te for r in ml.add_series_encoding(new, df).collect()] == [175.0, 175.0]


def test_select_model_compares_common_cells(spark):
    rows = [("easy", 1, 1, 1.0, 1.0), ("easy", 2, 1, 1.0, None), ("full", 1, 1, 1.0, 1.0), ("full", 2, 1, 1.0, 3.0)]
    pred = (spark.createDataFrame(rows, "model string, series int, h int, y double, p double")
            .selectExpr("model", "series", "'S' AS state", "DATE '2000-01-01' AS t", "h", "y", "p"))
    out = {r.model: (r["rank"], r.mean_smape, r.coverage) for r in fc.select_model(pred, ["full", "easy"]).collect()}
    assert out == {"full": (1, 0.0, 1.0), "easy": (2, 0.0, 0.5)}


def test_naive_forecasts_equal_single_models(spark):
    vals = {1: [float(i % 7 + i) for i in range(30)], 2: [3.0] * 30}
    p = _panel(spark, vals)
    both = sorted(map(tuple, fc.naive_forecasts(p).collect()))
    single = sorted(map(tuple, fc.persistence_forecast(p).unionByName(fc.seasonal_naive_forecast(p)).collect()))
    assert both == single


def test_sample_settings_deterministic_and_distinct():
    space = {"a": [True, False], "b": [1, 2, 3], "c": ("log", 1e-4, 1e-1)}
    one = ml.sample_settings(space, 8, seed=5)
    two = ml.sample_settings(space, 8, seed=5)
    assert one == two and len(one) == 8
    assert len({tuple(sorted(d.items())) for d in one}) == 8
    assert all(1e-4 <= d["c"] <= 1e-1 for d in one)


def test_undefined_errors_rank_last(spark):
    rows = [("m_null", 1, "S", None, 1, 1.0, None), ("m_ok", 1, "S", None, 1, 1.0, 2.0),
            ("m_ok", 2, "T", None, 1, 1.0, None)]
    pred = spark.createDataFrame(rows, "model string, series int, state string, t date, h int, y double, p double")
    sel = {r.model: r["rank"] for r in fc.select_model(pred, ["m_null", "m_ok"]).collect()}
    assert sel == {"m_ok": 1, "m_null": 2}
    best = {r.model: r.best_mean_smape for r in fc.smape_best_groups_mean(pred, 1).collect()}
    assert best["m_ok"] is not None and best["m_ok"] > 0


def test_backtest_calendar_roles(spark):
    p = _panel(spark, {1: list(range(20)), 2: list(range(20))})
    cal = fc.backtest_calendar(p).orderBy("t").collect()
    assert [r.role for r in cal] == ["input"] * 8 + ["holdout"] * 4
    assert [r.pos for r in cal] == list(range(1, 9)) + list(range(1, 5))


def test_recursive_forecast_reports_series_it_cannot_forecast(spark):
    rng = np.random.default_rng(1)
    rows = [(s, "A", [float(v) for v in rng.normal(size=8)], float(rng.normal())) for s in range(30)]
    train = ml.flatten_windows(spark.createDataFrame(rows, "series int, state string, x array<double>, target double"))
    model = ml.pooled_ar_pipeline("linear").fit(train)
    state = spark.createDataFrame(
        [(1, "A", [1.0] * 8), (2, "A", [1.0] * 7 + [None]), (3, "A", [1.0] * 5), (4, "A", None)],
        "series int, state string, x array<double>")
    horizons = spark.createDataFrame([(h, f"t{h}") for h in range(1, 5)], "h int, t string")
    out = ml.recursive_forecast(model, state, horizons).collect()
    assert len(out) == 16
    assert {r.series for r in out if r.p is None} == {2, 3, 4}
    assert sum(r.p is not None for r in out) == 4


def test_cross_validation_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), float(2 * a - b + rng.normal() / 9)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    lr = LinearRegression(labelCol="y", featuresCol="features", solver="normal")
    grid = [{lr.regParam: v} for v in (0.0, 0.5)]
    out = [[(round(r.avg_rmse, 9), round(r.holdout_rmse, 9), r.best) for r in ml.cross_validate(
        df.repartition(n), lr, grid, ["a", "b"], "y", split_keys=["id"]).collect()] for n in (1, 3)]
    assert out[0] == out[1]


def _noisy(spark, n=400):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(b), float(a * a - 2 * b + rng.normal() / 3)) for i, (a, b) in
            enumerate(np.round(rng.normal(size=(n, 2)), 1))]
    return spark.createDataFrame(rows, "id int, a double, b double, y double")


def test_cv_queries_run_the_reference_grids_on_both_inputs(spark, monkeypatch):
    from panelforge.plans import q_ml
    seen = []

    def fake(data, features, label, keys, folds, seed):
        seen.append((label, len(features), data.where(F.col(label).isNull()).count()))
        return spark.createDataFrame([(0.5,)], "avg_rmse double")

    for name in ("forest_grid", "boosted_grid"):
        monkeypatch.setattr(q_ml.ml, name, fake)
    for q in (q_ml.q_rf_cv, q_ml.q_gbt_cv):
        assert {r.input for r in q(spark, "/root/testdata/sf0.001").collect()} == {"lineitem", "panel_attributes"}
    assert seen == [("l_extendedprice", 4, 0), ("density", 10, 0)] * 2


def test_reference_grids_have_their_maps(spark):
    df = _noisy(spark, 120)
    small = {"maxDepth": (2, 105), "maxBins": (4, 8), "maxIter": (1, 2, 3)}
    out = ml.boosted_grid(df, ["a", "b"], "y", ["id"], small).collect()
    assert len(out) == 12 and sum(r.best for r in out) == 1
    assert {(r.maxDepth, r.requested_maxDepth) for r in out} == {(2, 2), (30, 105)}
    assert [len(v) for v in ml.C.GBT_GRID.values()] == [2, 2, 3] and [len(v) for v in ml.C.RF_GRID.values()] == [3, 3, 3]


def test_staged_errors_equal_separate_fits(spark):
    from pyspark.ml.regression import GBTRegressor
    df = ml.assemble(_noisy(spark), ["a", "b"]).checkpoint()
    train, valid = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    fit = lambda n: GBTRegressor(labelCol="y", featuresCol="features", maxDepth=3, maxBins=16, maxIter=n, seed=5).fit(train)
    # the label column of the model's parameters is used
    staged = ml.staged_errors(fit(12), valid)
    for n in (2, 5, 12):
        own = fit(n).transform(valid).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
        assert math.isclose(staged[n - 1], own, rel_tol=1e-9)


def test_forest_grid_does_not_depend_on_the_layout(spark):
    df = _noisy(spark)
    grid = {"numTrees": (2, 5), "maxDepth": (2, 4), "maxBins": (8,)}
    out = [[tuple(round(v, 9) for v in r) for r in ml.forest_grid(df.repartition(n), ["a", "b"], "y", ["id"], grid).collect()]
           for n in (1, 3, 8)]
    assert out[0] == out[1] == out[2] and len(out[0]) == 4
    imp = [ml.feature_importance(df.repartition(n), ["a", "b"], "y", 5, 3, layout_keys=["id"]).collect() for n in (1, 8)]
    assert imp[0] == imp[1]


def test_cv_reports_requested_values(spark):
    rows = [(i, float(i % 9), float(i % 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, y double")
    lr = LinearRegression(labelCol="y", featuresCol="features")
    out = ml.cross_validate(df, lr, [{lr.regParam: 0.0}, {lr.regParam: 0.5}], ["a"], "y", split_keys=["id"],
                            requested=[{"regParam": 0.0}, {"regParam": 9.0}]).collect()
    assert [(r.regParam, r.requested_regParam) for r in out] == [(0.0, 0.0), (0.5, 9.0)]


def test_keep_best_cuts_at_the_minimum(spark, tmp_path):
    from pyspark.ml.regression import GBTRegressionModel
    df = _noisy(spark)
    train, valid = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    model, curve = ml.gbt_keep_best(train, valid, ["a", "b"], "y", max_iter=25, patience=6, layout_keys=["id"])
    best = curve.index(min(curve)) + 1
    assert model.getNumTrees == best and len(curve) == min(25, best + 6)
    model.write().save(str(tmp_path / "m"))
    scored = GBTRegressionModel.load(str(tmp_path / "m")).transform(ml.assemble(valid, ["a", "b"]))
    rmse = scored.agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    assert math.isclose(rmse, min(curve), rel_tol=1e-9)


def test_first_iterations_equal_a_shorter_fit(spark, tmp_path):
    from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
    rows = ml.assemble(_noisy(spark), ["a", "b"]).select("features", "y")
    fit = lambda n: GBTRegressor(labelCol="y", maxIter=n, maxDepth=3, stepSize=0.3, seed=42).fit(rows)
    short, cut = fit(4), ml.first_iterations(fit(9), 4)
    cut.write().save(str(tmp_path / "cut"))
    loaded = GBTRegressionModel.load(str(tmp_path / "cut"))
    values = [[r.prediction for r in m.transform(rows).collect()] for m in (short, cut, loaded)]
    assert values[0] == values[1] == values[2]
    assert cut.getMaxIter() == 4 and cut.getNumTrees == 4 and cut.getMaxDepth() == 3
    assert cut.treeWeights == short.treeWeights and cut.toDebugString.split("\n")[1:] == short.toDebugString.split("\n")[1:]


def test_series_factors_tell_series_apart(spark):
    rng = np.random.default_rng(7)
    rows = [(f"s{s}", f"2020-{m:02d}", float((1 + s) * (m + 3) + rng.normal() / 10)) for s in range(6) for m in range(1, 13)]
    train = spark.createDataFrame(rows + [(None, "2020-01", 1.0), ("s0", "2020-02", None)],
                                  "series string, t string, target double")
    found = ml.series_factors(train, 4).collect()
    assert sorted(r.series for r in found) == [f"s{s}" for s in range(6)] and all(len(r.factors) == 4 for r in found)
    # the first direction follows the level of the series
    size = {r.series: float(np.linalg.norm(r.factors)) for r in found}
    assert sorted(size, key=size.get) == [f"s{s}" for s in range(6)]
    factors = spark.createDataFrame([(r.series, r.factors) for r in found], "series string, factors array<double>")
    new = spark.createDataFrame([("s0",), ("other",), (None,)], "series string")
    out = {r.series: r.series_factors.toArray().tolist() for r in ml.add_series_factors(new, factors, 4).collect()}
    assert out["other"] == out[None] == [0.0] * 4 and any(out["s0"])


def test_search_trials_share_equal_feature_stages(spark, monkeypatch):
    from pyspark.ml.feature import StringIndexer
    rows = [("ab"[i % 2], float(i % 7), float(i % 5), float(i % 7) + 2.0 * (i % 2) + 5.0) for i in range(80)]
    df = spark.createDataFrame(rows, "state string, x_1 double, x_2 double, target double")
    build = lambda s: ml.pooled_ar_pipeline("huber", 2, group_col="state" if s["use_state"] else None,
                                            reg_param=s["l2"])
    space = {"use_state": [True, False], "l2": [1e-5, 1e-3, 1e-1]}
    fits, fit = [], StringIndexer._fit
    monkeypatch.setattr(StringIndexer, "_fit", lambda self, data: fits.append(1) or fit(self, data))
    got = {r.params: r.smape for r in
           ml.random_search_pipelines(df, df, build, space, n_trials=6, label="target").collect()}
    assert len(got) == 6 and len(fits) == 1              # one fit of the index, not one per trial with it
    for s in ml.sample_settings(space, 6):
        want = ml.SmapeEvaluator(labelCol="target").evaluate(build(s).fit(df).transform(df))
        assert abs(got[", ".join(f"{k}={s[k]}" for k in sorted(s))] - want) < 1e-6


def test_select_model_runs_its_forecasts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def forecast(y):
        seen.add(1)
        return y + 1.0

    rows = [(m, s, months(1)[0], float(s)) for m in ("a", "b") for s in range(1, 6)]
    pred = spark.createDataFrame(rows, "model string, series int, t date, y double").withColumn("p", forecast("y"))
    out = {r.model: r["rank"] for r in fc.select_model(pred, ["b", "a"]).collect()}
    assert out == {"b": 1, "a": 2} and seen.value == len(rows)


def test_models_of_a_backtest_share_the_held_out_values(spark, monkeypatch):
    from panelforge.plans import fixtures as fx
    from panelforge.plans import q_ml
    sf = "/root/testdata/sf0.001"
    model = q_ml.pooled_model(spark, sf, "huber")
    q_ml._recursive_state(spark, sf)
    fx._memo.pop((*fx.session_key(spark), "actual", sf), None)
    repairs, repair = [], q_ml.win.zero_series_repair
    monkeypatch.setattr(q_ml.win, "zero_series_repair", lambda df: repairs.append(1) or repair(df))
    first, second = (q_ml.recursive_predictions(spark, sf, kind, model) for kind in ("huber", "rf"))
    assert len(repairs) == 1
    known = {(r.series, r.t): r.density for r in repair(fx.appended(spark, sf)).collect()}
    assert first.count() == second.count() > 0
    assert all(r.y == known[r.series, r.t] for r in first.collect())
