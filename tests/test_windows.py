import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from helpers import months
from panelforge.operators import timeseries as ts
from panelforge.operators import windows as win


def _panel(spark, series_values):
    rows = []
    for s, vals in series_values.items():
        for t, v in zip(months(len(vals)), vals):
            rows.append((s, t, None if v is None else float(v)))
    return spark.createDataFrame(rows, "series int, t date, density double")


def test_rolling_matches_pandas(spark):
    rng = np.random.default_rng(0)
    vals = {1: rng.normal(size=30).tolist(), 2: list(rng.normal(size=11)),
            3: [1.0] * 5 + [None] + [2.0] * 20}
    out = win.rolling_stats(_panel(spark, vals)).toPandas().sort_values(["series", "t"])
    for s, v in vals.items():
        ser = pd.Series([np.nan if x is None else x for x in v], dtype=float)
        got = out[out.series == s]
        np.testing.assert_allclose(got.roll_mean.to_numpy(dtype=float),
                                   ser.rolling(12).mean().to_numpy(), equal_nan=True, atol=1e-12)
        np.testing.assert_allclose(got.roll_std.to_numpy(dtype=float),
                                   ser.rolling(12).std().to_numpy(), equal_nan=True, atol=1e-12)


def test_diff_cumsum_restores(spark):
    vals = {1: [3.0, 5.0, 4.0, 10.0, 7.0]}
    d = win.diff(_panel(spark, vals)).orderBy("t").toPandas()
    assert len(d) == 4
    restored = 3.0 + d.d1.cumsum().to_numpy()
    np.testing.assert_allclose(restored, vals[1][1:])


def test_seasonal_diff_matches_pandas(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=40).cumsum().tolist()
    got = win.seasonal_diff(_panel(spark, {1: v})).orderBy("t").toPandas().d12.to_numpy()
    s = pd.Series(v).diff().dropna()
    exp = s.diff(12).dropna().to_numpy()
    np.testing.assert_allclose(got, exp, atol=1e-12)


def test_sequence_windows_counts_and_content(spark):
    # short fixture: 8, 9, 11, 12, 23, 24 rows -> T - 8 windows each (0 for 8)
    lens = [8, 9, 11, 12, 23, 24]
    vals = {i: list(range(n)) for i, n in enumerate(lens)}
    w = win.sequence_windows(_panel(spark, vals), length=8)
    counts = {r.series: r["count"] for r in w.groupBy("series").count().collect()}
    assert counts == {i: n - 8 for i, n in enumerate(lens) if n > 8}
    first = w.where("series = 5 AND pos = 0").first()
    assert first.x == [float(i) for i in range(8)] and first.target == 8.0


def test_sequence_windows_skip_nulls(spark):
    # gap fixture: a NULL target drops every window that would contain it
    vals = {1: [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None, 12]}
    w = win.sequence_windows(_panel(spark, vals), length=8)
    assert sorted(r.pos for r in w.collect()) == [0, 1]


def test_panel_split(spark):
    vals = {1: list(range(20)), 2: list(range(20))}
    w = win.sequence_windows(_panel(spark, vals), length=8)
    a = win.panel_split(w, 20).groupBy("split").count().collect()
    b = win.panel_split_by_series(w).groupBy("split").count().collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) == [("train", 16), ("valid", 8)]


def test_last_values_array(spark):
    arr = win.last_values_array(_panel(spark, {1: list(range(12))}), n=8).first().last_values
    assert arr == [float(i) for i in range(4, 12)]


def test_zero_series_repair(spark):
    # zeros fixture: one zero, all zeros, last value zero, no zero
    vals = {1: [1, 0, 3, 4], 2: [0, 0, 0, 0], 3: [1, 2, 3, 0], 4: [1, 2, 3, 4]}
    out = win.zero_series_repair(_panel(spark, vals)).toPandas()
    got = {s: out[out.series == s].sort_values("t").density.tolist() for s in vals}
    assert got == {1: [4.0] * 4, 2: [0.0] * 4, 3: [0.0] * 4, 4: [1.0, 2.0, 3.0, 4.0]}


def _np_decompose(y, period=12):
    y = np.asarray(y, float)
    n = len(y)
    filt = np.r_[0.5, np.ones(period - 1), 0.5] / period
    trend = np.full(n, np.nan)
    h = period // 2
    for i in range(h, n - h):
        trend[i] = np.dot(filt, y[i - h:i + h + 1])
    detr = y - trend
    pav = np.array([np.nanmean(detr[i::period]) for i in range(period)])
    pav -= pav.mean()
    seas = np.tile(pav, n // period + 1)[:n]
    return trend, seas, y - trend - seas


def test_decompose_matches_numpy_and_sums_back(spark):
    rng = np.random.default_rng(2)
    y = (np.arange(50) * 0.3 + np.tile(np.sin(np.arange(12)), 5)[:50] + rng.normal(size=50)).tolist()
    out = ts.decompose(_panel(spark, {1: y})).orderBy("t").toPandas()
    tr, se, re = _np_decompose(y)
    np.testing.assert_allclose(out.trend.to_numpy(float), tr, equal_nan=True, atol=1e-10)
    np.testing.assert_allclose(out.seasonal.to_numpy(float), se, atol=1e-10)
    np.testing.assert_allclose(out.resid.to_numpy(float), re, equal_nan=True, atol=1e-10)
    full = out.dropna()
    np.testing.assert_allclose(full.trend + full.seasonal + full.resid, full.y, atol=1e-10)


def test_decompose_seasonal_fixture_recovers_parts(spark):
    pattern = np.array([3, 1, -2, 0, 4, -1, -3, 2, 0, 1, -4, -1], float)
    pattern -= pattern.mean()
    y = (2.0 + 0.5 * np.arange(48) + np.tile(pattern, 4)).tolist()
    out = ts.decompose(_panel(spark, {1: y})).orderBy("t").toPandas()
    np.testing.assert_allclose(out.seasonal.to_numpy(float), np.tile(pattern, 4), atol=1e-9)
    mid = out.dropna()
    np.testing.assert_allclose(mid.resid, 0.0, atol=1e-9)


def test_decompose_short_series_null(spark):
    out = ts.decompose(_panel(spark, {1: list(range(23))})).toPandas()
    assert out.trend.isna().all() and out.seasonal.isna().all()
