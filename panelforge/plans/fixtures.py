"""Panel fixtures derived from the star-schema tables.

Mapping (decided once): ``supplier`` plays the series ("county"), its
``nation`` plays the group ("state") and the month of ``l_shipdate`` plays
the period.  The number of series grows with the data.

* ``panel``: one row per series x calendar month with the number of lines the
  supplier shipped (``active``) and ``density = 100 * active / customers of
  the supplier's nation``.  The calendar is every distinct ship month.
* ``attributes``: one row per series with its own balance and the customer and
  supplier aggregates of its nation, over all rows; ``avg_funded_bal`` averages
  only suppliers with a balance above ``FUNDED_BALANCE`` and is NULL for a
  nation without one.
* ``appended``: the panel as two extracts give it, the months before the last
  ``LATE_MONTHS`` and a late extract of those months without ``active``.
  Backtests and models read this one.

Scale notes: the only large input is ``lineitem``.  Its two columns are
counted per (supplier, month) with map-side combine in one pass and no join,
so a supplier or month with any number of lines is one row per task of the
shuffle.  The counts then meet the suppliers by key as one map of at most
#months entries per series, and months are spread in place.  The dense panel
has exactly (#series x #months) rows, hash-partitioned by series, sorted by
(series, t) and checkpointed to the shared folder, so per-series windows
downstream run without another shuffle and recovery never replays the scan.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..session import ensure_checkpoint_dir, session_key
from ..sources.tables import read_table

# Fixed values of the fixture definition.
FUNDED_BALANCE = 5000.0               # of the suppliers that avg_funded_bal averages
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
LATE_MONTHS = 4                       # months of the late-arriving panel
FUTURE_MONTHS = 4                     # months of the future panel
PANEL_ROWS_PER_PARTITION = 20_000     # target panel partition size (rows)

_lock = threading.RLock()
_memo: dict[tuple, DataFrame] = {}


def _memoized(spark: SparkSession, key: tuple, build) -> DataFrame:
    full = session_key(spark) + key
    # builds are serialised: two callers never build the same fixture, and no
    # plan is made while another build has AQE switched off
    with _lock:
        if full not in _memo:
            _memo[full] = build()
        return _memo[full]


def clear_memo() -> None:
    with _lock:
        _memo.clear()


def line_month_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, t, active) for every supplier-month with at least one line;
    lines without a supplier give rows with NULL series (they still define
    calendar months)."""
    return (read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate"])
            .where(F.col("l_shipdate").isNotNull())
            .groupBy(F.col("l_suppkey").alias("series"),
                     F.trunc(F.to_date("l_shipdate"), "month").alias("t"))
            .agg(F.count(F.lit(1)).cast("int").alias("active")))


def series_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, county, state, customers: every supplier with its nation and
    that nation's number of customers (NULL if it has none)."""
    supplier = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    customer = read_table(spark, sf_dir, "customer", ["c_nationkey"])
    per_nation = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return (supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .join(per_nation, F.col("s_nationkey") == F.col("c_nationkey"), "left")
            .select(F.col("s_suppkey").alias("series"), F.col("s_name").alias("county"),
                    F.col("n_name").alias("state"), "customers"))


def build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel ``series, county, state, t, active, density``."""
    ensure_checkpoint_dir(spark)
    # at most #series x #months rows, read three times below: bounds, calendar
    # and cells.  A checkpoint rather than a cache: under AQE a cached plan
    # keeps all shuffle partitions uncoalesced, a checkpoint is written from
    # the coalesced plan (and cuts lineage).
    counts = line_month_counts(spark, sf_dir).checkpoint(eager=True)
    bounds = counts.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    if bounds["lo"] is None:
        n_months, months = 0, F.array().cast("array<date>")
    else:
        lo, hi = bounds["lo"], bounds["hi"]
        n_months = (hi.year - lo.year) * 12 + hi.month - lo.month + 1
        months = F.sequence(F.lit(lo), F.lit(hi), F.expr("INTERVAL 1 MONTH"))
    # the months of a calendar: under 120,000 for any DATE
    calendar = F.broadcast(counts.select("t").distinct())
    n_parts = panel_partitions(spark, sf_dir, n_months)
    by_month = (counts.where(F.col("series").isNotNull()).repartition(n_parts, "series")
                .groupBy("series")
                .agg(F.map_from_entries(F.collect_list(F.struct("t", "active"))).alias("_m")))
    # Every series gets every month between the bounds (explode, no cross
    # join); the semi join keeps only months that occur in the data.
    cells = (series_dim(spark, sf_dir).repartition(n_parts, "series")
             .join(by_month, "series", "left")
             .select("series", "county", "state", "customers", "_m", F.explode(months).alias("t"))
             .join(calendar, "t", "left_semi")
             .withColumn("active", F.coalesce(F.element_at("_m", F.col("t")), F.lit(0))))
    panel = cells.select(
        "series", "county", "state", "t", "active",
        (F.col("active").cast("double") * F.lit(100.0) / F.col("customers")).alias("density"))
    return checkpoint_clustered(clustered(panel, n_parts))


def clustered(df: DataFrame, n_parts: int) -> DataFrame:
    return df.repartition(n_parts, "series").sortWithinPartitions("series", "t")


def panel_partitions(spark: SparkSession, sf_dir: str, n_months: int) -> int:
    """Partition count of the panel: its exact row count (#series x #months)
    divided by the target partition size, capped by the shuffle partition
    setting.  Keeps downstream per-series tasks full instead of launching
    thousands of empty ones for a small panel on a large cluster."""
    # Parquet answers the count from footer metadata
    n_series = read_table(spark, sf_dir, "supplier").count()
    cap = int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = -(-max(n_series * n_months, 1) // PANEL_ROWS_PER_PARTITION)
    return max(1, min(cap, want))


def checkpoint_clustered(df: DataFrame) -> DataFrame:
    """Checkpoint a DataFrame keeping its hash partitioning and sort order.

    A checkpoint taken under adaptive execution reports an unknown
    partitioning, so every later per-series window would shuffle again.
    Taking it with AQE off (only for this panel-sized job) keeps
    ``hashpartitioning(series)`` and the (series, t) order on the result."""
    spark = df.sparkSession
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memoized dense panel for ``sf_dir`` in this session."""
    return _memoized(spark, ("panel", sf_dir), lambda: build_panel(spark, sf_dir))


def build_fixtures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Panel and attributes.  One after the other: the panel's checkpoint
    switches AQE off for its own job, which a plan made meanwhile would see."""
    return panel(spark, sf_dir), attributes(spark, sf_dir)


def holdout(spark: SparkSession, sf_dir: str, valid: int = C.VALIDATION_LENGTH) -> DataFrame:
    """(t, h) of the last ``valid`` calendar months, computed once per
    session (a ``valid``-row checkpoint shared by every backtest query)."""
    from ..operators.forecast import holdout_calendar
    return _memoized(spark, ("holdout", sf_dir, valid),
                     lambda: holdout_calendar(panel(spark, sf_dir), valid).checkpoint(eager=True))


def _late_months(spark: SparkSession, sf_dir: str, months: int) -> DataFrame:
    """The last ``months`` calendar months (that many rows)."""
    return F.broadcast(
        panel(spark, sf_dir).select("t").distinct()
        .select("t", F.dense_rank().over(_desc_t()).alias("_r"))
        .where(F.col("_r") <= months).select("t"))


def base_panel(spark: SparkSession, sf_dir: str, months: int = LATE_MONTHS) -> DataFrame:
    """The panel before its last ``months`` calendar months."""
    return panel(spark, sf_dir).join(_late_months(spark, sf_dir, months), "t", "left_anti")


def late_panel(spark: SparkSession, sf_dir: str, months: int = LATE_MONTHS) -> DataFrame:
    """The last ``months`` calendar months of the panel, without ``active``
    (the shape of a late-arriving extract)."""
    p = panel(spark, sf_dir)
    return p.join(_late_months(spark, sf_dir, months), "t", "left_semi").drop("active")


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and late extract as one panel, laid out like ``panel``."""
    from ..operators.joins import append_panel

    def build():
        both = append_panel(base_panel(spark, sf_dir), late_panel(spark, sf_dir))
        n_parts = panel(spark, sf_dir).rdd.getNumPartitions()
        return checkpoint_clustered(clustered(both, n_parts))
    return _memoized(spark, ("appended", sf_dir), build)


def _desc_t():
    from pyspark.sql import Window
    return Window.orderBy(F.col("t").desc())


def future_panel(spark: SparkSession, sf_dir: str, months: int = FUTURE_MONTHS) -> DataFrame:
    """``series, t`` for ``months`` months after the calendar."""
    p = panel(spark, sf_dir)
    per_series = p.groupBy("series").agg(F.max("t").alias("_last"))
    return per_series.select(
        "series",
        F.explode(F.sequence(F.add_months("_last", 1), F.add_months("_last", months),
                             F.expr("INTERVAL 1 MONTH"))).alias("t"))


def attributes(spark: SparkSession, sf_dir: str,
               funded_balance: float = FUNDED_BALANCE) -> DataFrame:
    """One row per series: its balance, and of its nation the customer count,
    mean balance, market-segment shares, supplier count and mean balance, and
    the mean balance of the suppliers above ``funded_balance`` (NULL where
    there is none)."""
    def build():
        customer = read_table(spark, sf_dir, "customer",
                              ["c_nationkey", "c_acctbal", "c_mktsegment"])
        shares = [F.avg(F.when(F.col("c_mktsegment") == s, 1.0).otherwise(0.0))
                  .alias(f"share_{s.lower()}") for s in SEGMENTS]
        cust = customer.groupBy(F.col("c_nationkey").alias("_nation")).agg(
            F.count(F.lit(1)).alias("customers"), F.avg("c_acctbal").alias("avg_acctbal"),
            *shares)
        supplier = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
        funded = F.when(F.col("s_acctbal") > F.lit(funded_balance), F.col("s_acctbal"))
        supp = supplier.groupBy(F.col("s_nationkey").alias("_nation")).agg(
            F.count(F.lit(1)).alias("suppliers"), F.avg("s_acctbal").alias("avg_supp_bal"),
            F.avg(funded).alias("avg_funded_bal"))
        out = (supplier.withColumnRenamed("s_nationkey", "_nation")
               .join(supp.join(cust, "_nation", "left"), "_nation", "left")
               .select(F.col("s_suppkey").alias("series"), "customers", "avg_acctbal",
                       *[f"share_{s.lower()}" for s in SEGMENTS], "suppliers",
                       F.col("s_acctbal").alias("supp_bal"), "avg_supp_bal", "avg_funded_bal"))
        return out.checkpoint(eager=True)
    return _memoized(spark, ("attributes", sf_dir, funded_balance), build)


def typed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with every column rendered as a string (CSV-like input)."""
    p = panel(spark, sf_dir)
    return p.select(*[F.col(c).cast("string").alias(c) for c in p.columns])
