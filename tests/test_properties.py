"""Property tests over random inputs (hypothesis)."""

import numpy as np
from hypothesis import given, settings, strategies as st

from helpers import months
from panelforge.operators import aggregates as agg
from panelforge.operators import timeseries as ts
from panelforge.operators import windows as win

SETTINGS = settings(max_examples=8, deadline=None)


def test_global_rank_is_a_sorted_permutation(spark):
    @SETTINGS
    @given(st.lists(st.integers(-50, 50), min_size=1, max_size=200), st.integers(1, 7))
    def check(keys, parts):
        df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int").repartition(parts)
        rows = win.global_rank(df, "k", "rk", partitions=parts).collect()
        assert sorted(r.rk for r in rows) == list(range(len(keys)))
        by_rank = sorted(rows, key=lambda r: r.rk)
        assert [r.k for r in by_rank] == sorted(keys)
    check()


def test_key_coverage_matches_sets(spark):
    @SETTINGS
    @given(st.lists(st.one_of(st.none(), st.integers(0, 30)), max_size=40),
           st.lists(st.one_of(st.none(), st.integers(0, 30)), max_size=40))
    def check(a, b):
        pa = spark.createDataFrame([(k,) for k in a], "series int")
        pb = spark.createDataFrame([(k,) for k in b], "series int")
        r = agg.key_coverage(pa, pb).first()
        sa, sb = {k for k in a if k is not None}, {k for k in b if k is not None}
        assert (r.panel_keys, r.attr_keys, r.common_keys) == (len(sa), len(sb), len(sa & sb))
    check()


def test_decomposition_adds_up(spark):
    @SETTINGS
    @given(st.integers(24, 60), st.integers(0, 10_000))
    def check(n, seed):
        rng = np.random.default_rng(seed)
        y = (rng.normal(size=n).cumsum() + np.tile(rng.normal(size=12), n // 12 + 1)[:n]).tolist()
        rows = [(1, t, float(v)) for t, v in zip(months(n), y)]
        out = ts.decompose(spark.createDataFrame(rows, "series int, t date, density double")).toPandas()
        full = out.dropna()
        assert len(full) == n - 12
        np.testing.assert_allclose(full.trend + full.seasonal + full.resid, full.y, atol=1e-9)
        # seasonal component is centred and 12-periodic
        seas = out.sort_values("t").seasonal.to_numpy(dtype=float)
        np.testing.assert_allclose(seas[12:], seas[:-12], atol=1e-9)
        assert abs(seas[:12].mean()) < 1e-9
    check()


def test_window_counts(spark):
    @SETTINGS
    @given(st.lists(st.integers(0, 30), min_size=1, max_size=6))
    def check(lengths):
        rows = [(s, t, float(i)) for s, n in enumerate(lengths) for i, t in enumerate(months(n))]
        df = spark.createDataFrame(rows, "series int, t date, density double")
        w = win.sequence_windows(df)
        assert w.count() == sum(max(n - 8, 0) for n in lengths)
        d = win.diff(df)
        assert d.count() == sum(max(n - 1, 0) for n in lengths)
    check()
