"""Plan-shape regression tests: the scale properties the design relies on."""

import pytest

from conftest import SF_ORACLE
from panelforge.operators import timeseries as ts
from panelforge.operators import windows as win
from panelforge.plans import fixtures as fx


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def spread_panel(spark):
    """The panel laid out over several hash partitions, as on a cluster."""
    old = fx.PANEL_ROWS_PER_PARTITION
    fx.PANEL_ROWS_PER_PARTITION = 100
    try:
        p = fx.build_panel(spark, SF_ORACLE)
    finally:
        fx.PANEL_ROWS_PER_PARTITION = old
    assert p.rdd.getNumPartitions() > 1
    return p


OPS = {
    "rolling_stats": lambda p: win.rolling_stats(p),
    "diff": lambda p: win.diff(p),
    "seasonal_diff": lambda p: win.seasonal_diff(p),
    "sequence_windows": lambda p: win.sequence_windows(p, extra=("state",)),
    "zero_series_repair": lambda p: win.zero_series_repair(p),
    "last_values": lambda p: win.last_values(p),
    "decompose": lambda p: ts.decompose(p),
    "acf": lambda p: ts.acf(p),
    "pacf": lambda p: ts.pacf(p),
    "adf": lambda p: ts.adf(p),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_per_series_operators_do_not_shuffle(spark, spread_panel, name):
    plan = _plan(OPS[name](spread_panel))
    assert "Exchange" not in plan, plan


def test_lineitem_scan_is_pruned_and_filtered(spark):
    plan = _plan(fx.line_month_counts(spark, SF_ORACLE))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line and "l_shipdate" in line][0]
    assert "PushedFilters: [IsNotNull(l_shipdate)]" in scan
    assert "ReadSchema: struct<l_suppkey:bigint,l_shipdate:timestamp_ntz>" in scan
    assert "Join" not in plan


def test_ids_shuffle_nothing_on_the_state(spark):
    from panelforge.plans.q_relational import id_table, q_future_state_ids
    id_table(spark, SF_ORACLE)
    assert "hashpartitioning(state" not in _plan(q_future_state_ids(spark, SF_ORACLE))
