"""Backtest evaluation queries (slice 3): persistence and seasonal-naive
forecasts of the zero-repaired panel, scored by SMAPE and RMSE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import forecast as fc
from ..operators import windows as win
from . import fixtures as fx
from .catalog import register, rounded
from .q_windows import REPAIR_SQL

BASELINE_MODELS = ["persistence", "seasonal_naive"]


def baseline_predictions(spark, sf_dir) -> DataFrame:
    return fc.naive_forecasts(win.zero_series_repair(fx.appended(spark, sf_dir)),
                              holdout=fx.holdout(spark, sf_dir))


PRED_SQL = REPAIR_SQL + """,
vd AS (
  SELECT t, CAST(5 - rk AS INTEGER) AS h
  FROM (SELECT t, row_number() OVER (ORDER BY t DESC) AS rk FROM cal) x WHERE rk <= 4
),
base AS (
  SELECT r.series, r.state, r.t, r.density AS y, vd.h,
         lag(r.density, 12) OVER (PARTITION BY r.series ORDER BY r.t) AS p_seas,
         arg_max(CASE WHEN vd.h IS NULL THEN r.density END, CASE WHEN vd.h IS NULL THEN r.t END)
           OVER (PARTITION BY r.series) AS p_last
  FROM repaired r LEFT JOIN vd ON r.t = vd.t
),
pred AS (
  SELECT 'persistence' AS model, series, state, t, h, y, p_last AS p FROM base WHERE h IS NOT NULL
  UNION ALL
  SELECT 'seasonal_naive' AS model, series, state, t, h, y, p_seas AS p FROM base WHERE h IS NOT NULL
),
scored AS (
  SELECT *, CASE WHEN y + abs(p) = 0 THEN 0.0
                 ELSE 200.0 * abs(y - p) / (y + abs(p)) END AS e
  FROM pred
)
"""


@register("backtest_calendar", """
SELECT t, CASE WHEN rk <= 4 THEN 'holdout' ELSE 'input' END AS role,
       CAST(CASE WHEN rk <= 4 THEN 5 - rk ELSE 13 - rk END AS INTEGER) AS pos
FROM (SELECT t, row_number() OVER (ORDER BY t DESC) AS rk FROM cal) x
WHERE rk <= 12
""")
def q_backtest_calendar(spark, sf_dir):
    return fc.backtest_calendar(fx.panel(spark, sf_dir))


@register("backtest_persistence", "WITH " + PRED_SQL + """
SELECT model, series, state, t, h, round(y, 6) AS y, round(p, 6) AS p FROM pred
""")
def q_backtest_persistence(spark, sf_dir):
    return rounded(baseline_predictions(spark, sf_dir))


@register("smape_by_series", "WITH " + PRED_SQL + """
SELECT model, series, round(avg(e), 6) AS smape FROM scored GROUP BY model, series
""")
def q_smape_by_series(spark, sf_dir):
    return rounded(fc.smape_by(baseline_predictions(spark, sf_dir), ["series"]))


@register("smape_by_date", "WITH " + PRED_SQL + """
SELECT model, t, h, round(avg(e), 6) AS smape FROM scored GROUP BY model, t, h
""")
def q_smape_by_date(spark, sf_dir):
    return rounded(fc.smape_by(baseline_predictions(spark, sf_dir), ["t", "h"]))


@register("smape_by_group", "WITH " + PRED_SQL + """
SELECT model, state, round(avg(e), 6) AS smape FROM scored GROUP BY model, state
""")
def q_smape_by_group(spark, sf_dir):
    return rounded(fc.smape_by(baseline_predictions(spark, sf_dir), ["state"]))


@register("smape_by_horizon", "WITH " + PRED_SQL + """,
pd AS (SELECT model, t, h, avg(e) AS smape FROM scored GROUP BY model, t, h)
SELECT model, round(avg(CASE WHEN h = 1 THEN smape END), 6) AS public,
       round(avg(CASE WHEN h > 1 THEN smape END), 6) AS private
FROM pd GROUP BY model
""")
def q_smape_by_horizon(spark, sf_dir):
    return rounded(fc.smape_by_horizon(baseline_predictions(spark, sf_dir)))


@register("smape_macro", "WITH " + PRED_SQL + """,
s AS (SELECT model, avg(smape) AS mean_series_smape
      FROM (SELECT model, series, avg(e) AS smape FROM scored GROUP BY model, series) x GROUP BY model),
g AS (SELECT model, avg(smape) AS mean_group_smape
      FROM (SELECT model, state, avg(e) AS smape FROM scored GROUP BY model, state) x GROUP BY model)
SELECT s.model, round(mean_series_smape, 6) AS mean_series_smape,
       round(mean_group_smape, 6) AS mean_group_smape
FROM s JOIN g ON s.model = g.model
""")
def q_smape_macro(spark, sf_dir):
    return rounded(fc.smape_macro(baseline_predictions(spark, sf_dir)))


@register("smape_best6_mean", "WITH " + PRED_SQL + """,
g AS (SELECT model, state, avg(e) AS smape FROM scored GROUP BY model, state),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY smape, state) AS rk FROM g)
SELECT model, round(avg(smape), 6) AS best_mean_smape, count(*) AS n_groups
FROM r WHERE rk <= 6 GROUP BY model
""")
def q_smape_best6_mean(spark, sf_dir):
    return rounded(fc.smape_best_groups_mean(baseline_predictions(spark, sf_dir), 6))


@register("rmse_by_group", "WITH " + PRED_SQL + """
SELECT model, state, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM pred GROUP BY model, state
""")
def q_rmse_by_group(spark, sf_dir):
    return rounded(fc.rmse_by(baseline_predictions(spark, sf_dir), ["state"]))


@register("backtest_select", "WITH " + PRED_SQL + """,
shared AS (SELECT series, t FROM scored WHERE e IS NOT NULL GROUP BY series, t HAVING count(DISTINCT model) = 2),
m AS (SELECT model, avg(smape) AS mean_smape
      FROM (SELECT model, series, avg(e) AS smape FROM scored JOIN shared USING (series, t)
            GROUP BY model, series) x GROUP BY model),
c AS (SELECT model, count(e) / count(*) AS coverage FROM scored GROUP BY model)
SELECT model, round(mean_smape, 6) AS mean_smape, round(coverage, 6) AS coverage,
       CAST(row_number() OVER (ORDER BY mean_smape,
            CASE model WHEN 'persistence' THEN 1 ELSE 2 END) AS INTEGER) AS rank,
       row_number() OVER (ORDER BY mean_smape,
            CASE model WHEN 'persistence' THEN 1 ELSE 2 END) = 1 AS selected
FROM c LEFT JOIN m USING (model)
""")
def q_backtest_select(spark, sf_dir):
    out = fc.select_model(baseline_predictions(spark, sf_dir), BASELINE_MODELS)
    return rounded(out.withColumn("rank", F.col("rank").cast("int")))
