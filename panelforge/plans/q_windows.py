"""Window queries: rolling stats, differences, sequence windows, split,
zero repair, decomposition, ACF (slice 2 and the SQL part of slice 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as ts
from ..operators import windows as win
from . import fixtures as fx
from .catalog import register, rounded



@register("rolling_stats", """
SELECT series, t, round(density, 6) AS density,
       round(CASE WHEN count(density) OVER w = 12 THEN avg(density) OVER w END, 6) AS roll_mean,
       round(CASE WHEN count(density) OVER w = 12 THEN stddev_samp(density) OVER w END, 6) AS roll_std
FROM panel
WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
""")
def q_rolling_stats(spark, sf_dir):
    return rounded(win.rolling_stats(fx.panel(spark, sf_dir)))


D1_SQL = """
d1 AS (
  SELECT series, t, d1 FROM (
    SELECT series, t, density - lag(density, 1) OVER (PARTITION BY series ORDER BY t) AS d1
    FROM panel) x WHERE d1 IS NOT NULL
),
d12 AS (
  SELECT series, t, d12 FROM (
    SELECT series, t, d1 - lag(d1, 12) OVER (PARTITION BY series ORDER BY t) AS d12 FROM d1) x
  WHERE d12 IS NOT NULL
)
"""


@register("diff1", "WITH " + D1_SQL + "SELECT series, t, round(d1, 6) AS d1 FROM d1")
def q_diff1(spark, sf_dir):
    return rounded(win.diff(fx.panel(spark, sf_dir)))


@register("seasonal_diff", "WITH " + D1_SQL + "SELECT series, t, round(d12, 6) AS d12 FROM d12")
def q_seasonal_diff(spark, sf_dir):
    return rounded(win.seasonal_diff(fx.panel(spark, sf_dir)))


SEQ_SQL = """
sq AS (
  SELECT series, t,
         CAST(row_number() OVER w - 9 AS INTEGER) AS pos,
         count(density) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS c9,
         """ + ",\n         ".join(
    f"round(lag(density, {9 - i}) OVER w, 6) AS x_{i}" for i in range(1, 9)) + """,
         round(density, 6) AS target
  FROM panel WINDOW w AS (PARTITION BY series ORDER BY t)
)
"""
SEQ_COLS = "series, t, pos, " + ", ".join(f"x_{i}" for i in range(1, 9)) + ", target"


def _flat_windows(spark, sf_dir):
    w = win.sequence_windows(fx.panel(spark, sf_dir))
    return w.select("series", "t", F.col("pos").cast("int").alias("pos"),
                    *[F.element_at("x", i).alias(f"x_{i}") for i in range(1, 9)], "target", "x")


@register("sequence_windows", "WITH " + SEQ_SQL + f"SELECT {SEQ_COLS} FROM sq WHERE c9 = 9")
def q_sequence_windows(spark, sf_dir):
    return rounded(_flat_windows(spark, sf_dir).drop("x"))


@register("panel_split", "WITH " + SEQ_SQL + """
SELECT series, t, pos, target,
       CASE WHEN pos < count(*) OVER (PARTITION BY series) - 4 THEN 'train' ELSE 'valid' END AS split
FROM sq WHERE c9 = 9
""")
def q_panel_split(spark, sf_dir):
    w = win.sequence_windows(fx.panel(spark, sf_dir))
    labelled = win.panel_split_by_series(w)
    return rounded(labelled.select("series", "t", F.col("pos").cast("int").alias("pos"),
                                   "target", "split"))


@register("last_targets", """
SELECT series, t, round(density, 6) AS density, k FROM (
  SELECT series, t, density, CAST(row_number() OVER (PARTITION BY series ORDER BY t DESC) AS INTEGER) AS k
  FROM panel) x WHERE k <= 8
""")
def q_last_targets(spark, sf_dir):
    out = win.last_values(fx.panel(spark, sf_dir))
    return rounded(out.withColumn("k", F.col("k").cast("int")))


REPAIR_SQL = """
repaired AS (
  SELECT series, county, state, t,
         CASE WHEN max(CASE WHEN density = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series) = 1
              THEN arg_max(density, t) OVER (PARTITION BY series) ELSE density END AS density
  FROM panel
)
"""


@register("zero_series_repair", "WITH " + REPAIR_SQL +
          "SELECT series, t, round(density, 6) AS density FROM repaired")
def q_zero_series_repair(spark, sf_dir):
    return rounded(win.zero_series_repair(fx.panel(spark, sf_dir)).select("series", "t", "density"))


def _decompose_sql(src: str, ycol: str) -> str:
    """SQL of ``ts.decompose`` over ``src(series, t, <ycol>)``."""
    return f"""
s1 AS (
  SELECT series, t, {ycol} AS y,
         CASE WHEN count({ycol}) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13
              THEN (sum({ycol}) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
                    - 0.5 * (lag({ycol}, 6) OVER (PARTITION BY series ORDER BY t)
                             + lead({ycol}, 6) OVER (PARTITION BY series ORDER BY t))) / 12.0 END AS trend,
         (row_number() OVER (PARTITION BY series ORDER BY t) - 1) % 12 AS phase,
         count(*) OVER (PARTITION BY series) AS n
  FROM {src}
),
s2 AS (
  SELECT *, avg(y - trend) OVER (PARTITION BY series, phase) AS pavg,
         row_number() OVER (PARTITION BY series, phase ORDER BY t) = 1 AS first
  FROM s1
),
s3 AS (
  SELECT *, avg(CASE WHEN first THEN pavg END) OVER (PARTITION BY series) AS centre FROM s2
)
SELECT series, t, round(y, 6) AS y,
       round(CASE WHEN n >= 24 THEN trend END, 6) AS trend,
       round(CASE WHEN n >= 24 THEN pavg - centre END, 6) AS seasonal,
       round(CASE WHEN n >= 24 THEN y - trend - (pavg - centre) END, 6) AS resid
FROM s3
"""


MEAN_SQL = """
ms AS (SELECT CAST(0 AS INTEGER) AS series, t, avg(density) AS density FROM panel GROUP BY t)
"""


@register("mean_series_decompose", "WITH " + MEAN_SQL + "," + _decompose_sql("ms", "density"))
def q_mean_series_decompose(spark, sf_dir):
    """T5 as the reference calls it: on the mean series over all series."""
    from ..operators.aggregates import mean_series
    return rounded(ts.decompose(mean_series(fx.panel(spark, sf_dir))))


@register("decompose_level", "WITH " + _decompose_sql("panel", "density"))
def q_decompose_level(spark, sf_dir):
    return rounded(ts.decompose(fx.panel(spark, sf_dir)))


@register("decompose_diff", "WITH " + D1_SQL + "," + _decompose_sql("d1", "d1"))
def q_decompose_diff(spark, sf_dir):
    return rounded(ts.decompose(win.diff(fx.panel(spark, sf_dir)), y="d1"))


@register("decompose_seasonal_diff", "WITH " + D1_SQL + "," + _decompose_sql("d12", "d12"))
def q_decompose_seasonal_diff(spark, sf_dir):
    return rounded(ts.decompose(win.seasonal_diff(fx.panel(spark, sf_dir)), y="d12"))


ACF_R_SQL = """
c AS (
  SELECT series, t, density - avg(density) OVER (PARTITION BY series) AS c,
         row_number() OVER (PARTITION BY series ORDER BY t) AS rn
  FROM panel
),
prod AS (
  SELECT a.series, k.k, sum(a.c * b.c) AS s
  FROM c a JOIN (SELECT unnest(range(1, (SELECT max(rn) // 2 FROM c))) AS k) k ON TRUE
  JOIN c b ON a.series = b.series AND b.rn = a.rn - k.k
  GROUP BY a.series, k.k
),
s0 AS (SELECT series, count(c) AS n, sum(c * c) AS s0 FROM c GROUP BY series),
r AS (
  SELECT s0.series, CAST(prod.k AS INTEGER) AS k, prod.s / s0.s0 AS acf, s0.n,
         least(CAST(ceil(10.0 * log10(s0.n)) AS INTEGER), CAST(s0.n // 2 AS INTEGER)) AS kk
  FROM s0 JOIN prod ON prod.series = s0.series
)
"""


@register("acf_by_series", "WITH " + ACF_R_SQL + """
SELECT series, k, round(acf, 6) AS acf,
       round(1.96 * sqrt((1.0 + 2.0 * coalesce(sum(acf * acf) OVER (PARTITION BY series ORDER BY k
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / n), 6) AS band, n
FROM r WHERE k <= kk
""")
def q_acf_by_series(spark, sf_dir):
    return rounded(ts.acf(fx.panel(spark, sf_dir)))
