import math

import numpy as np
from pyspark.sql import functions as F

from helpers import months
from panelforge.operators import timeseries as ts


def _panel(spark, series_values):
    rows = [(s, t, float(v)) for s, vals in series_values.items()
            for t, v in zip(months(len(vals)), vals)]
    return spark.createDataFrame(rows, "series int, t date, density double")


def _np_acf(y, K):
    y = np.asarray(y, float) - np.mean(y)
    d = np.dot(y, y)
    return np.array([np.dot(y[k:], y[:-k]) / d for k in range(1, K + 1)])


def test_acf_matches_numpy(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=80).cumsum()
    out = ts.acf(_panel(spark, {7: y.tolist()})).orderBy("k").toPandas()
    K = min(math.ceil(10 * math.log10(80)), 40)
    assert out.k.tolist() == list(range(1, K + 1))
    r = _np_acf(y, K)
    np.testing.assert_allclose(out.acf, r, atol=1e-12)
    band = 1.96 * np.sqrt((1 + 2 * np.r_[0, np.cumsum(r[:-1] ** 2)]) / 80)
    np.testing.assert_allclose(out.band, band, atol=1e-12)


def test_acf_lags_follow_the_length(spark):
    y = np.random.default_rng(5).normal(size=300)
    out = ts.acf(_panel(spark, {1: y.tolist()})).orderBy("k").toPandas()
    assert len(out) == 25
    np.testing.assert_allclose(out.acf, _np_acf(y, 25), atol=1e-12)


def test_series_key_of_any_type(spark):
    y = np.random.default_rng(6).normal(size=60).cumsum()
    df = _panel(spark, {1: y.tolist(), 2: (-y).tolist()}).withColumn("series", F.concat(F.lit("s"), "series"))
    assert {r.series for r in ts.adf(df).collect()} == {"s1", "s2"}
    assert {r.series for r in ts.pacf(df).collect()} == {"s1", "s2"}
    stats = {r.stat for r in ts.ts_summary(df).collect()}
    assert stats == {"y", "acf", "acf_band", "pacf", "pacf_band", "adf_stat", "adf_p", "adf_lag", "adf_n_obs",
                     "adf_crit_1", "adf_crit_5", "adf_crit_10"}


def test_pacf_matches_yule_walker(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=200)
    y = np.zeros(200)
    for i in range(2, 200):
        y[i] = 0.6 * y[i - 1] - 0.3 * y[i - 2] + e[i]
    out = ts.pacf(_panel(spark, {1: y.tolist()})).orderBy("k").toPandas()
    K = len(out)
    r = _np_acf(y, K)
    exp = []
    for k in range(1, K + 1):
        R = np.array([[1.0 if i == j else r[abs(i - j) - 1] for j in range(k)] for i in range(k)])
        exp.append(np.linalg.solve(R, r[:k])[-1])
    np.testing.assert_allclose(out.pacf, exp, atol=1e-9)
    assert abs(out.pacf[0] - 0.6 / 1.3) < 0.1 and abs(out.pacf[1] + 0.3) < 0.1


def _np_adf_tau(x, lags):
    dx = np.diff(x)
    n = len(dx) - lags
    cols = [x[lags:lags + n]] + [dx[lags - j:lags - j + n] for j in range(1, lags + 1)] + [np.ones(n)]
    X = np.column_stack(cols)
    yv = dx[lags:]
    beta = np.linalg.lstsq(X, yv, rcond=None)[0]
    res = yv - X @ beta
    s2 = res @ res / (n - X.shape[1])
    return beta[0] / math.sqrt(s2 * np.linalg.inv(X.T @ X)[0, 0])


def test_adf_statistic_matches_direct_ols():
    rng = np.random.default_rng(5)
    x = rng.normal(size=100).cumsum()
    res = ts.adf_test(x)
    assert res is not None
    assert math.isclose(res["adf_stat"], _np_adf_tau(x, res["used_lag"]), rel_tol=1e-9)
    assert res["n_obs"] == 99 - res["used_lag"]
    assert 0 <= res["p_value"] <= 1
    assert res["crit_1"] < res["crit_5"] < res["crit_10"] < 0


def test_adf_pvalue_branches_meet():
    lo = ts.adf_pvalue(-1.61)
    hi = ts.adf_pvalue(-1.6099999)
    assert abs(lo - hi) < 5e-3 and abs(lo - 0.478) < 0.01
    assert ts.adf_pvalue(3.0) == 1.0 and ts.adf_pvalue(-20.0) == 0.0


def test_adf_constant_and_short_are_null():
    assert ts.adf_test(np.ones(50)) is None
    assert ts.adf_test(np.arange(11.0)) is None


def test_adf_size_and_power_simulation(spark):
    # random_walk / white_noise fixtures: 300 / 100 seeded series of 100 steps
    rng = np.random.default_rng(1999)
    rows = []
    for s in range(300):
        for t, v in zip(months(100), rng.normal(size=100).cumsum()):
            rows.append((s, t, float(v)))
    for s in range(300, 400):
        for t, v in zip(months(100), rng.normal(size=100)):
            rows.append((s, t, float(v)))
    df = spark.createDataFrame(rows, "series int, t date, density double")
    res = ts.adf(df).toPandas()
    rw = res[res.series < 300]
    wn = res[res.series >= 300]
    size = (rw.p_value < 0.05).mean()
    power = (wn.p_value < 0.05).mean()
    assert 0.01 <= size <= 0.12, size
    assert power >= 0.9, power


def test_adf_expression_equals_the_kernel(spark):
    rng = np.random.default_rng(11)
    values = {i: (rng.normal(size=n).cumsum() * 10.0 ** (i % 4 - 1) + 5 * i).tolist()
              for i, n in enumerate((12, 13, 14, 20, 47, 83, 120, 300))}
    values[20] = rng.normal(size=90).tolist()                       # stationary: the other branch of the p-value
    values[21] = (np.arange(60) ** 1.5 + rng.normal(size=60)).tolist()    # a trend: p near 1
    values[30], values[31] = [2.0] * 40, [float(i) for i in range(11)]
    df = _panel(spark, values).unionByName(spark.createDataFrame(
        [(40, t, v) for t, v in zip(months(30), [1.0, None] * 15)] + [(None, t, 1.0) for t in months(20)],
        "series int, t date, density double"))
    got = {r.series: r for r in ts.adf(df).collect()}
    assert got.keys() == values.keys() | {40}
    for s, x in values.items():
        want = ts.adf_test(np.array(x))
        if want is None:
            assert all(v is None for v in got[s][1:])
            continue
        for name, v in want.items():
            assert math.isclose(got[s][name], v, rel_tol=1e-7, abs_tol=1e-8), (s, name, got[s][name], v)
    assert all(v is None for v in got[40][1:])


def test_dashboard_rows(spark):
    y = np.random.default_rng(12).normal(size=40)
    out = {(r.stat, r.k): r.value for r in ts.ts_summary(_panel(spark, {1: y.tolist()})).collect()}
    assert [out["y", i + 1] for i in range(40)] == y.tolist()
    assert math.isclose(out["acf_band", 1], 1.96 / math.sqrt(40)) and out["acf_band", 5] > out["acf_band", 1]
    assert math.isclose(out["pacf_band", 3], 1.96 / math.sqrt(40))
    res = ts.adf_test(y)
    assert (out["adf_lag", 0], out["adf_n_obs", 0]) == (res["used_lag"], res["n_obs"])
