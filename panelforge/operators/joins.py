"""Keyed joins, lookups and appends (inventory J1-J7, U1, U4).

Joins never rely on row positions: every alignment is an equi-join on
explicit keys.  Broadcast decisions:

* sides whose size is bounded by construction (k top keys, V hold-out
  periods, the months of a calendar) are broadcast explicitly by the caller;
* a side the caller wants broadcast under an explicit row bound goes through
  ``bounded_broadcast`` (a LIMIT-count check, shuffle join above the bound);
* everything else is left to the planner: Spark broadcasts a side only when
  its size estimate is under ``spark.sql.autoBroadcastJoinThreshold`` and
  AQE re-checks with runtime sizes, otherwise it is a sort-merge join whose
  skewed partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import global_rank

# Largest dimension we broadcast without asking the planner.
BROADCAST_MAX_ROWS = 1_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows (a LIMIT scan stops early),
    so it stays cheap even when the side is large; a side above the bound is
    returned unchanged and joined by shuffle."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def harmonize_key(df: DataFrame, key: str, dtype: str = "int") -> DataFrame:
    """Cast a join key to one integer type (the reference joined a string key
    to a float one).  Malformed keys become NULL and never match."""
    return df.withColumn(key, F.col(key).try_cast(dtype))


def panel_attr_join(panel: DataFrame, attrs: DataFrame, key: str = "series",
                    how: str = "inner", attr_max_rows: int | None = None) -> DataFrame:
    """Attributes (one row per key) joined onto the panel (N rows per key).

    The attribute table grows with the number of series, so by default the
    planner picks the strategy from its size; ``attr_max_rows`` forces a
    broadcast under that checked bound."""
    side = bounded_broadcast(attrs, attr_max_rows) if attr_max_rows else attrs
    return panel.join(side, key, how)


def common_keys(left: DataFrame, right: DataFrame, key: str = "series") -> DataFrame:
    """Keys present on both sides.  A left-semi join avoids the 1:N blow-up
    of an inner join followed by ``distinct``."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi")


def append_panel(panel: DataFrame, late: DataFrame) -> DataFrame:
    """Append late rows by column name; missing columns become NULL and
    duplicates are kept (as ``pd.concat``)."""
    return panel.unionByName(late, allowMissingColumns=True)


def dense_ids(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Dense 0-based ids for the distinct values of ``key``, in sorted
    key order (first-seen order is not stable in a distributed scan).

    The keys are de-duplicated first (partial aggregation), then ranked by a
    distributed global rank (no single-task window)."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return global_rank(keys, key, id_col)


def lookup_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Attach the dense id of a key (one id row per key, so no
    duplication).  Rows whose key is missing from the dictionary are dropped
    here and reported by ``missing_keys``."""
    return df.join(ids, key, "inner")


def attach_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """J3, keeping every row: a key without an id gets a NULL one."""
    return df.join(ids, key, "left")


def missing_keys(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Keys of ``df`` absent from the id table (the reference raised KeyError)."""
    return df.select(key).distinct().join(ids.select(key), key, "left_anti")
