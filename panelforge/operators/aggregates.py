"""Grouped aggregates, rankings and reports (inventory A1-A18, O1-O5, P10).

All aggregates are hash aggregates with a map-side partial step, so a hot
group (one state holding a third of the rows) is combined before the shuffle.
Rankings are total orders (value, then key) so ties are deterministic, and
top-k uses ``orderBy().limit()`` which Spark plans as a distributed
TakeOrderedAndProject (k rows per task reach the driver, never the table).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.exprs import days_from, pairwise_corr, series_label, sign_colour

DEFAULT_ANCHOR = dt.date(2000, 1, 1)


def group_sizes(panel: DataFrame, group: str = "state", key: str = "series") -> DataFrame:
    """A1/O1: rows per group (the reference's 'counties per state' bar chart
    counts county-months) together with the number of distinct series."""
    return (panel.groupBy(group)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_series"))
            .orderBy(F.col("n_rows").desc(), F.col(group)))


def group_time_corr(panel: DataFrame, group: str = "state", y: str = "density",
                    t: str = "t", anchor: dt.date = DEFAULT_ANCHOR) -> DataFrame:
    """A5/P10/O2: Pearson correlation of (days since anchor, y) per group,
    with a colour for the sign, ascending by correlation (NULLs first)."""
    days = days_from(t, anchor)
    return (panel.groupBy(group)
            .agg(pairwise_corr(days, y).alias("correlation"))
            .select("correlation", group, sign_colour("correlation").alias("color"))
            .orderBy(F.col("correlation").asc_nulls_first(), F.col(group)))


def series_time_corr(panel: DataFrame, y: str = "density", t: str = "t",
                     anchor: dt.date = DEFAULT_ANCHOR) -> DataFrame:
    """The same correlation per series, keyed by (county, state) and
    labelled ``"county, state"``."""
    days = days_from(t, anchor)
    return (panel.groupBy("series", "county", "state")
            .agg(pairwise_corr(days, y).alias("correlation"))
            .select("series", series_label("county", "state").alias("county_state"),
                    "state", "correlation"))


def ranked_corr_series(panel: DataFrame, n: int = C.TOP_N_SERIES, least: bool = False,
                       y: str = "density",
                       t: str = "t", anchor: dt.date = DEFAULT_ANCHOR) -> DataFrame:
    """O3: the ``n`` series with the largest (``least=False``) or smallest
    correlation, returned with their whole history for plotting.

    Series with a NULL correlation are not ranked.  The top-k runs on the
    per-series table; its k keys are joined back to the panel by broadcast
    (k is a parameter, so the broadcast side is bounded)."""
    corr = series_time_corr(panel, y, t, anchor).where(F.col("correlation").isNotNull())
    order = F.col("correlation").asc() if least else F.col("correlation").desc()
    top = corr.orderBy(order, F.col("series")).limit(n)
    ranked = top.select("series", "county_state", F.round("correlation", 2).alias("corr_2dp"),
                        F.row_number().over(Window.orderBy(order, F.col("series"))).alias("rank"))
    return panel.join(F.broadcast(ranked), "series").select(
        "rank", "series", "county_state", "corr_2dp", t, y)


def key_coverage(panel: DataFrame, attrs: DataFrame, key: str = "series") -> DataFrame:
    """Distinct keys in the panel, in the attribute table and in
    both, as a one-row report.  Both key sets are flagged, unioned and
    grouped once by key (one shuffle, no join)."""
    flags = (panel.select(key, F.lit(1).alias("_p"), F.lit(0).alias("_a"))
             .unionByName(attrs.select(key, F.lit(0).alias("_p"), F.lit(1).alias("_a")))
             .where(F.col(key).isNotNull()))
    per_key = flags.groupBy(key).agg(F.max("_p").alias("_p"), F.max("_a").alias("_a"))
    return per_key.agg(
        F.coalesce(F.sum("_p"), F.lit(0)).cast("bigint").alias("panel_keys"),
        F.coalesce(F.sum("_a"), F.lit(0)).cast("bigint").alias("attr_keys"),
        F.count_if((F.col("_p") == 1) & (F.col("_a") == 1)).alias("common_keys"))


def null_profile(df: DataFrame, column: str, keys: tuple[str, ...] = ("county", "state")) -> DataFrame:
    """NULL count of ``column`` per (county, state), only for keys that
    have at least one NULL.  County names repeat across states, so the state
    is part of the key."""
    return (df.where(F.col(column).isNull()).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_nulls"))
            .withColumn("column", F.lit(column)))


def null_profiles(df: DataFrame, columns: list[str],
                  keys: tuple[str, ...] = ("county", "state")) -> DataFrame:
    """A7 for several columns in one pass: NULLs are counted per key and
    column in one aggregate, whose result is unpivoted to (key, column,
    n_nulls); columns without a NULL give no row."""
    counts = df.groupBy(*keys).agg(*[F.count_if(F.col(c).isNull()).alias(f"_n{i}")
                                     for i, c in enumerate(columns)])
    stacked = counts.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n_nulls"))
        for i, c in enumerate(columns)])).alias("_c"))
    return stacked.select(*keys, "_c.column", "_c.n_nulls").where("n_nulls > 0")


def mean_series(panel: DataFrame, y: str = "density", t: str = "t",
                key_value: int = 0) -> DataFrame:
    """Mean of ``y`` over series per period (NULLs skipped).  A constant
    ``series`` column keeps the result in the (series, t, y) shape that every
    per-series operator accepts."""
    return (panel.groupBy(t).agg(F.avg(y).alias(y))
            .select(F.lit(key_value).cast("int").alias("series"), t, y))


def panel_profile(panel: DataFrame, key: str = "series", t: str = "t", y: str = "density") -> DataFrame:
    """Shape of the panel (rows, series, distinct periods, range, NULL
    and zero targets) as a one-row report."""
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_series"),
        F.count_distinct(t).alias("n_periods"), F.min(t).alias("first_t"),
        F.max(t).alias("last_t"), F.count_if(F.col(y).isNull()).alias("n_null"),
        F.count_if(F.col(y) == 0).alias("n_zero"))


def series_endpoints(panel: DataFrame, attrs: DataFrame, key: str = "series",
                     t: str = "t", y: str = "density") -> DataFrame:
    """For each attribute row with panel data, the group at the
    first period and the value at the last period."""
    ends = panel.groupBy(key).agg(
        F.min_by("state", t).alias("first_state"), F.max_by(y, t).alias("last_value"),
        F.max(t).alias("last_t"))
    return attrs.select(key).join(ends, key, "inner")
