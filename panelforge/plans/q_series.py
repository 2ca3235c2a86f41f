"""Per-series statistics (slice 4): PACF, ADF, dashboard.

PACF and ADF run as JVM expressions and have DuckDB oracles (recursive CTEs:
Durbin-Levinson, and orthonormal columns added lag by lag).  ADF is also
checked against the numpy kernel and a size/power simulation in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.adf_kernel import ADF_CRIT, ADF_LARGE_P, ADF_SMALL_P, ADF_TAU_MAX, ADF_TAU_MIN, ADF_TAU_STAR
from ..operators import timeseries as ts
from ..operators.aggregates import mean_series
from ..operators.windows import rolling_stats
from . import fixtures as fx
from .catalog import register, rounded
from .q_windows import ACF_R_SQL

PACF_SQL = "WITH RECURSIVE " + ACF_R_SQL + """,
arr AS (
  SELECT series, any_value(n) AS n,
         least(any_value(kk), CAST(any_value(n) // 2 AS INTEGER) - 1) AS kp,
         list(acf ORDER BY k) AS r
  FROM r GROUP BY series
),
dl AS (
  SELECT series, n, kp, r, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST(1.0 AS DOUBLE) AS v,
         CAST(NULL AS DOUBLE) AS pk
  FROM arr WHERE kp >= 1
  UNION ALL
  SELECT d.series, d.n, d.kp, d.r, d.k + 1,
         list_concat(list_transform(range(1, d.k + 1),
                                    lambda j: d.phi[j] - x.a * d.phi[d.k + 1 - j]), [x.a]),
         d.v * (1 - x.a * x.a), x.a
  FROM dl d, LATERAL (
    SELECT (d.r[d.k + 1] - coalesce(list_sum(list_transform(range(1, d.k + 1),
                                    lambda j: d.phi[j] * d.r[d.k + 1 - j])), 0.0)) / d.v AS a) x
  WHERE d.k < d.kp
)
SELECT series, CAST(k AS INTEGER) AS k, round(pk, 6) AS pacf, round(1.96 / sqrt(n), 6) AS band, n
FROM dl WHERE k >= 1
"""


@register("pacf_by_series", PACF_SQL)
def q_pacf_by_series(spark, sf_dir):
    return rounded(ts.pacf(fx.panel(spark, sf_dir)))


def adf_sql(source: str) -> str:
    """CTEs up to ``adf`` (the columns of ``timeseries.adf``) for the series of
    ``source`` (series, t, density): orthonormal columns added one lag at a
    time by a recursive CTE, twice projected; the normal distribution function
    by Simpson's rule."""
    poly = lambda coef, x: " + ".join(f"({c}) * pow({x}, {i})" for i, c in enumerate(coef))
    crit = ", ".join(" + ".join(f"({b}) / pow(nobs, {i})" for i, b in enumerate(c)) + f" AS {name}"
                     for name, c in ADF_CRIT.items())
    simpson = ("list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 "
               "THEN 4 ELSE 2 END) * exp(-0.5 * pow(u * i / 2000, 2)))) * u / 6000 / sqrt(2 * pi())")

    def fold(name, base, columns, count):
        project = ("list_transform(range(1, len({v}) + 1), lambda i: {v}[i] - coalesce(list_sum(list_transform(f.q, "
                   "lambda e: list_dot_product(e, {v}) * e[i])), 0.0))")
        return f"""
{name} AS (
  SELECT series, 0 AS k, y, CAST([] AS DOUBLE[][]) AS q, CAST(NULL AS DOUBLE) AS z, CAST(NULL AS DOUBLE) AS ssr FROM {base}
  UNION ALL
  SELECT f.series, f.k + 1, w.y, list_append(f.q, w.e), w.z, list_dot_product(w.y, w.y)
  FROM {name} f JOIN {base} b ON b.series = f.series AND f.k < {count},
  LATERAL (SELECT {columns} AS c) c0,
  LATERAL (SELECT {project.format(v="c0.c")} AS c) c1,
  LATERAL (SELECT {project.format(v="c1.c")} AS c) c2,
  LATERAL (SELECT list_transform(c2.c, lambda x: x / sqrt(list_dot_product(c2.c, c2.c))) AS e) u,
  LATERAL (SELECT u.e, list_dot_product(u.e, f.y) AS z,
                  list_transform(range(1, len(f.y) + 1), lambda i: f.y[i] - list_dot_product(u.e, f.y) * u.e[i]) AS y) w
)"""

    centre = "list_transform({c}, lambda v: v - list_avg({c}))"
    lagged = lambda j: centre.format(c=f"b.dx[b.m - b.nobs - ({j}) + 1 : b.m - ({j})]")
    level = centre.format(c="b.x[b.m - b.nobs + 1 : b.m]")
    target = centre.format(c="dx[m - nobs + 1 : m]")
    return f"""
xs AS (SELECT series, list(density ORDER BY t) AS x, count(*) AS n, count(density) AS full_n FROM {source} GROUP BY series),
dx AS (
  SELECT series, x, n - 1 AS m, list_transform(range(1, n), lambda i: x[i + 1] - x[i]) AS dx,
         CAST(least(ceil(12 * pow(n / 100.0, 0.25)), n // 2 - 2) AS INTEGER) AS most
  FROM xs WHERE n >= 12 AND full_n = n AND list_max(x) > list_min(x)
),
b1 AS (SELECT *, {target} AS y FROM (SELECT *, m - most AS nobs FROM dx)),
{fold("g1", "b1", f"CASE WHEN f.k = 0 THEN {level} ELSE {lagged('f.k')} END", "b.most + 1").strip()},
ic AS (
  SELECT series, k - 1 AS lag, nobs * (ln(2 * pi()) + 1 + ln(ssr / nobs)) + 2 * (k + 1) AS ic
  FROM g1 JOIN b1 USING (series) WHERE k >= 1 AND ssr > 0
),
best AS (SELECT * FROM ic QUALIFY row_number() OVER (PARTITION BY series ORDER BY ic, lag) = 1),
b2 AS (SELECT *, {target} AS y FROM (SELECT dx.*, best.lag, best.ic, m - best.lag AS nobs FROM dx JOIN best USING (series))),
{fold("g2", "b2", f"CASE WHEN f.k = b.lag THEN {level} ELSE {lagged('f.k + 1')} END", "b.lag + 1").strip()},
tau AS (
  SELECT b2.series, lag, nobs, ic, z / sqrt(ssr / (nobs - lag - 2)) AS tau
  FROM g2 JOIN b2 ON b2.series = g2.series AND g2.k = b2.lag + 1 WHERE ssr > 0 AND nobs > lag + 2
),
adf AS (
  SELECT xs.series, tau AS adf_stat,
         CASE WHEN tau > {ADF_TAU_MAX} THEN 1.0 WHEN tau < {ADF_TAU_MIN} OR u < -8 THEN 0.0 WHEN u > 8 THEN 1.0
              ELSE 0.5 + {simpson} END AS p_value,
         CAST(lag AS INTEGER) AS used_lag, CAST(nobs AS INTEGER) AS n_obs, {crit}, ic AS ic_best
  FROM xs LEFT JOIN (SELECT *, CASE WHEN tau <= {ADF_TAU_STAR} THEN {poly(ADF_SMALL_P, "tau")}
                                    ELSE {poly(ADF_LARGE_P, "tau")} END AS u FROM tau) v ON v.series = xs.series
)
"""


ADF_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("adf_stat", "p_value", *ADF_CRIT, "ic_best"))


@register("adf_by_series", "WITH RECURSIVE " + adf_sql("panel") + f"SELECT series, used_lag, n_obs, {ADF_ROUNDED} FROM adf")
def q_adf_by_series(spark, sf_dir):
    return rounded(ts.adf(fx.panel(spark, sf_dir)))


_ADF_ROWS = " UNION ALL ".join(f"SELECT series, '{stat}' AS stat, 0 AS k, CAST({c} AS DOUBLE) AS value FROM adf" for stat, c in (
    ("adf_stat", "adf_stat"), ("adf_p", "p_value"), ("adf_lag", "used_lag"), ("adf_n_obs", "n_obs"),
    *((f"adf_{c}", c) for c in ADF_CRIT)))


@register("ts_summary", PACF_SQL[:PACF_SQL.rindex("SELECT series")].rstrip() + "," + adf_sql("panel") + f"""
SELECT series, stat, CAST(k AS INTEGER) AS k, round(value, 6) AS value FROM (
  SELECT series, 'y' AS stat, row_number() OVER (PARTITION BY series ORDER BY t) AS k, density AS value FROM panel
  UNION ALL SELECT series, 'acf', k, acf FROM r WHERE k <= kk
  UNION ALL SELECT series, 'acf_band', k, 1.96 * sqrt((1.0 + 2.0 * coalesce(sum(acf * acf) OVER (
      PARTITION BY series ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / n) FROM r WHERE k <= kk
  UNION ALL SELECT series, 'pacf', k, pk FROM dl WHERE k >= 1
  UNION ALL SELECT series, 'pacf_band', k, 1.96 / sqrt(n) FROM dl WHERE k >= 1
  UNION ALL {_ADF_ROWS}
)
""")
def q_ts_summary(spark, sf_dir):
    return rounded(ts.ts_summary(fx.panel(spark, sf_dir)))


@register("mean_series_stationarity", "WITH RECURSIVE ms AS (SELECT CAST(0 AS INTEGER) AS series, t, avg(density) AS density "
          "FROM panel GROUP BY t)," + adf_sql("ms") + """
SELECT series, 'rolling' AS part, t, round(density, 6) AS density,
       round(CASE WHEN count(density) OVER w = 12 THEN avg(density) OVER w END, 6) AS roll_mean,
       round(CASE WHEN count(density) OVER w = 12 THEN stddev_samp(density) OVER w END, 6) AS roll_std,
       CAST(NULL AS DOUBLE) AS adf_stat, CAST(NULL AS DOUBLE) AS p_value, CAST(NULL AS INTEGER) AS used_lag,
       CAST(NULL AS INTEGER) AS n_obs, CAST(NULL AS DOUBLE) AS crit_1, CAST(NULL AS DOUBLE) AS crit_5,
       CAST(NULL AS DOUBLE) AS crit_10
FROM ms WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
UNION ALL
SELECT series, 'adf', NULL, NULL, NULL, NULL, round(adf_stat, 6), round(p_value, 6), used_lag, n_obs,
       round(crit_1, 6), round(crit_5, 6), round(crit_10, 6) FROM adf
""")
def q_mean_series_stationarity(spark, sf_dir):
    """T1/T8 as the reference's stationarity check runs: rolling mean/std and
    the ADF test of the mean series with its lag, observations and critical
    values, as one long table.  The mean series (one row per month) is computed
    once."""
    ms = mean_series(fx.panel(spark, sf_dir)).checkpoint(eager=True)
    roll = rolling_stats(ms).select("series", F.lit("rolling").alias("part"), "t", "density", "roll_mean", "roll_std")
    test = ts.adf(ms).drop("ic_best").withColumn("part", F.lit("adf"))
    return rounded(roll.unionByName(test, allowMissingColumns=True))
