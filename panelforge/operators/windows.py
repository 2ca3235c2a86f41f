"""Per-series window operators (inventory W1-W12, T8, T10).

Every window here is partitioned by the series key and ordered by time, so
the panel's hash partitioning on ``series`` (see ``plans.fixtures``) satisfies
the window's required distribution and no shuffle is added.  Lag, lead and
rolling columns that share one spec are computed in one ``select`` so Spark
sorts once.  Frames are ROWS frames over a dense panel: a "12-row" window is
twelve months.  Each partition group is one series, bounded by the calendar
length, never by data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def series_window(key: str | list[str] = "series", order: str = "t"):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(order)


def global_rank(df: DataFrame, key: str, out: str, partitions: int | None = None,
                checkpoint: bool = True) -> DataFrame:
    """0-based rank of every row of ``df`` by ``key`` without a single-task
    window: rows are range-partitioned and sorted; the position inside a
    partition comes from ``monotonically_increasing_id`` (partition id in
    the upper bits, row index in the lower 33), and the row counts of all
    earlier partitions are added from a table with one row per partition.

    The positioned table feeds two branches (partition sizes and the final
    join); it is checkpointed once so the range shuffle runs once and both
    branches see the same positions."""
    # Without an explicit count AQE may coalesce neighbouring ranges, which
    # keeps partition ids in key order.
    parted = (df.repartitionByRange(partitions, F.col(key)) if partitions
              else df.repartitionByRange(F.col(key)))
    ranged = (parted.sortWithinPartitions(key)
              .select("*", F.spark_partition_id().alias("_pid"),
                      F.monotonically_increasing_id().alias("_mid")))
    if checkpoint:
        ranged = ranged.checkpoint(eager=True)
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .select(*[c for c in df.columns], (F.col("_off") + local).cast("bigint").alias(out)))


def rolling_stats(df: DataFrame, y: str = "density", window: int = C.ROLLING_WINDOW,
                  key: str = "series", order: str = "t") -> DataFrame:
    """Trailing mean and sample standard deviation over ``window``
    rows; NULL until the window holds ``window`` non-null values (pandas
    ``rolling(window)`` semantics)."""
    w = series_window(key, order).rowsBetween(-(window - 1), 0)
    full = F.count(y).over(w) == window
    return df.select(key, order, y,
                     F.when(full, F.avg(y).over(w)).alias("roll_mean"),
                     F.when(full, F.stddev_samp(y).over(w)).alias("roll_std"))


def diff(df: DataFrame, y: str = "density", lag: int = 1, out: str = "d1",
         key: str = "series", order: str = "t") -> DataFrame:
    """``y - lag(y)``; rows without a predecessor (or with NULLs) dropped."""
    w = series_window(key, order)
    return (df.select(key, order, (F.col(y) - F.lag(y, lag).over(w)).alias(out))
            .where(F.col(out).isNotNull()))


def seasonal_diff(df: DataFrame, y: str = "density", period: int = C.SEASONAL_PERIOD,
                  key: str = "series", order: str = "t") -> DataFrame:
    """The lag-``period`` difference of the first difference, both with
    their leading rows dropped (row positions, as pandas ``diff().dropna()``)."""
    d1 = diff(df, y, 1, "d1", key, order)
    return diff(d1, "d1", period, "d12", key, order)


def sequence_windows(df: DataFrame, y: str = "density", length: int = C.SEQUENCE_LENGTH,
                     key: str = "series", order: str = "t", extra: tuple[str, ...] = ()) -> DataFrame:
    """Sliding windows of ``length + 1`` consecutive rows, step 1.

    ``x`` holds the first ``length`` values, ``target`` the last; the row's
    ``t`` is the target's period and ``pos`` the 0-based window number.
    Windows that are incomplete, or that contain a NULL, are dropped.
    ``extra`` columns of the target row are carried along (no join back)."""
    w = series_window(key, order)
    frame = w.rowsBetween(-length, 0)
    seq = F.collect_list(y).over(frame)
    out = (df.select(key, *extra, order, seq.alias("_s"),
                     (F.row_number().over(w) - 1 - length).alias("pos"))
           .where(F.size("_s") == length + 1)
           .select(key, *extra, order, "pos", F.slice("_s", 1, length).alias("x"),
                   F.element_at("_s", -1).alias("target")))
    return out


def panel_split(windows: DataFrame, n_periods: Column | int, length: int = C.SEQUENCE_LENGTH,
                valid: int = C.VALIDATION_LENGTH, key: str = "series") -> DataFrame:
    """Label windows 'train' or 'valid'.  Per series the first
    ``T - length - valid`` windows train and the rest validate, where T is
    the number of calendar periods."""
    n_train = (F.lit(n_periods) if isinstance(n_periods, int) else n_periods) - length - valid
    return windows.withColumn(
        "split", F.when(F.col("pos") < n_train, F.lit("train")).otherwise(F.lit("valid")))


def panel_split_by_series(windows: DataFrame, valid: int = C.VALIDATION_LENGTH,
                          key: str = "series") -> DataFrame:
    """W6 for ragged panels: the last ``valid`` windows of each series
    validate, the earlier ones train (equal to ``panel_split`` when every
    series covers the whole calendar)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return windows.withColumn(
        "split", F.when(F.col("pos") < n - valid, F.lit("train")).otherwise(F.lit("valid")))


def last_values(df: DataFrame, y: str = "density", n: int = C.SEQUENCE_LENGTH,
                key: str = "series", order: str = "t", extra: tuple[str, ...] = ()) -> DataFrame:
    """The last ``n`` values of each series, ``k`` = 1 for the latest
    (``extra`` columns are carried along)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return (df.select(key, *extra, order, y, F.row_number().over(w).alias("k"))
            .where(F.col("k") <= n))


def last_values_array(df: DataFrame, y: str = "density", n: int = C.SEQUENCE_LENGTH,
                      key: str = "series", order: str = "t") -> DataFrame:
    """W7 as one ordered array per series (oldest first)."""
    last = last_values(df, y, n, key, order)
    return last.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(order, y))),
                    lambda s: s[y]).alias("last_values"))


def centred_ma(y: str, period: int = C.SEASONAL_PERIOD, key: str = "series",
               order: str = "t") -> Column:
    """Centred moving average of an even ``period`` (the 2 x period MA:
    end points weighted 1/2); NULL unless the full span is present."""
    half = period // 2
    w = series_window(key, order)
    span = w.rowsBetween(-half, half)
    ends = F.lag(y, half).over(w) + F.lead(y, half).over(w)
    total = F.sum(y).over(span) - F.lit(0.5) * ends
    return F.when(F.count(y).over(span) == period + 1, total / F.lit(float(period)))


def zero_series_repair(df: DataFrame, y: str = "density", key: str = "series",
                       order: str = "t") -> DataFrame:
    """A series that contains a zero anywhere gets its whole history
    replaced by its last value (the reference's repair rule)."""
    w = Window.partitionBy(key)
    has_zero = F.max((F.col(y) == 0).cast("int")).over(w) == 1
    last = F.max_by(F.col(y), F.col(order)).over(w)
    return df.withColumn(y, F.when(has_zero, last).otherwise(F.col(y)))


def last_dates(df: DataFrame, n: int, order: str = "t", skip: int = 0) -> DataFrame:
    """Calendar periods ranked from the latest (1) backwards; returns the
    ``n`` periods after skipping the latest ``skip``.  Runs on the distinct
    periods only (bounded by the calendar)."""
    dates = df.select(order).distinct()
    ranked = dates.select(order, F.dense_rank().over(Window.orderBy(F.col(order).desc())).alias("rk"))
    return ranked.where((F.col("rk") > skip) & (F.col("rk") <= skip + n))
