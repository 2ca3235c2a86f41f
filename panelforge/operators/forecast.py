"""Backtests and forecast evaluation (inventory T11, T13, T14, A9-A17, M8).

A backtest holds out the last ``valid`` calendar periods of every series.
Forecasts are rows ``(model, series, state, t, h, y, p)`` with ``h`` the
horizon (1 = first held-out period); every error report is a grouped
aggregate of the per-row SMAPE term over those rows, so all models and all
series are scored in one job.  The held-out calendar is a table of
``valid`` rows (broadcast), never a driver-side list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.exprs import smape_term
from ..session import ensure_checkpoint_dir

PRED_COLS = ["model", "series", "state", "t", "h", "y", "p"]


def holdout_calendar(panel: DataFrame, valid: int = C.VALIDATION_LENGTH, t: str = "t") -> DataFrame:
    """(t, h) for the last ``valid`` periods; h = 1 for the earliest of them.
    Ranks the distinct periods only (bounded by the calendar length)."""
    dates = panel.select(t).distinct()
    rk = F.row_number().over(Window.orderBy(F.col(t).desc()))
    return (dates.select(t, rk.alias("_rk")).where(F.col("_rk") <= valid)
            .select(t, (F.lit(valid + 1) - F.col("_rk")).cast("int").alias("h")))


def backtest_calendar(panel: DataFrame, length: int = C.SEQUENCE_LENGTH,
                      valid: int = C.VALIDATION_LENGTH, t: str = "t") -> DataFrame:
    """The calendar of a backtest: the last ``valid`` periods ('holdout',
    pos 1 = first held-out) and the ``length`` periods before them ('input',
    pos 1 = oldest), i.e. the window the first forecast reads.  Ranks the
    distinct periods only (bounded by the calendar length)."""
    dates = panel.select(t).distinct()
    rk = F.row_number().over(Window.orderBy(F.col(t).desc()))
    ranked = dates.select(t, rk.alias("_rk")).where(F.col("_rk") <= valid + length)
    holdout = F.col("_rk") <= valid
    return ranked.select(
        t, F.when(holdout, F.lit("holdout")).otherwise(F.lit("input")).alias("role"),
        F.when(holdout, F.lit(valid + 1) - F.col("_rk"))
         .otherwise(F.lit(valid + length + 1) - F.col("_rk")).cast("int").alias("pos"))


def _mark_holdout(panel: DataFrame, valid: int, y: str, holdout: DataFrame | None) -> DataFrame:
    cal = F.broadcast(holdout if holdout is not None else holdout_calendar(panel, valid))
    return panel.join(cal, "t", "left").select("series", "state", "t", "h", F.col(y).alias("y"))


def persistence_forecast(panel: DataFrame, valid: int = C.VALIDATION_LENGTH,
                         y: str = "density", holdout: DataFrame | None = None) -> DataFrame:
    """Every held-out period is predicted by the series' value at the
    last period before the hold-out.  ``holdout`` (from ``holdout_calendar``)
    can be shared between models so the calendar is computed once."""
    marked = _mark_holdout(panel, valid, y, holdout)
    hist = F.col("h").isNull()
    last = F.max_by(F.when(hist, F.col("y")), F.when(hist, F.col("t"))).over(
        Window.partitionBy("series"))
    return (marked.select("*", last.alias("p")).where(F.col("h").isNotNull())
            .select(F.lit("persistence").alias("model"), *PRED_COLS[1:]))


def seasonal_naive_forecast(panel: DataFrame, valid: int = C.VALIDATION_LENGTH,
                            y: str = "density", period: int = C.SEASONAL_PERIOD,
                            holdout: DataFrame | None = None) -> DataFrame:
    """Seasonal naive: the value ``period`` rows earlier (needs period >= valid
    so that the prediction only uses history)."""
    if period < valid:
        raise ValueError("period must be >= valid")
    marked = _mark_holdout(panel, valid, y, holdout)
    w = Window.partitionBy("series").orderBy("t")
    return (marked.select("*", F.lag("y", period).over(w).alias("p"))
            .where(F.col("h").isNotNull())
            .select(F.lit("seasonal_naive").alias("model"), *PRED_COLS[1:]))


def naive_forecasts(panel: DataFrame, valid: int = C.VALIDATION_LENGTH, y: str = "density",
                    period: int = C.SEASONAL_PERIOD, holdout: DataFrame | None = None) -> DataFrame:
    """Persistence and seasonal-naive forecasts from one windowed pass over
    the panel (one hold-out calendar, one sort), unpivoted to one row per
    model.  Same rows as the union of the two single-model functions."""
    if period < valid:
        raise ValueError("period must be >= valid")
    marked = _mark_holdout(panel, valid, y, holdout)
    hist = F.col("h").isNull()
    last = F.max_by(F.when(hist, F.col("y")), F.when(hist, F.col("t"))).over(
        Window.partitionBy("series"))
    seas = F.lag("y", period).over(Window.partitionBy("series").orderBy("t"))
    both = marked.select("*", last.alias("_p1"), seas.alias("_p2")).where(F.col("h").isNotNull())
    models = F.explode(F.array(
        F.struct(F.lit("persistence").alias("model"), F.col("_p1").alias("p")),
        F.struct(F.lit("seasonal_naive").alias("model"), F.col("_p2").alias("p"))))
    return (both.select("series", "state", "t", "h", "y", models.alias("_m"))
            .select(F.col("_m.model").alias("model"), "series", "state", "t", "h", "y",
                    F.col("_m.p").alias("p")))


def with_smape(pred: DataFrame, strict: bool = False) -> DataFrame:
    return pred.withColumn("_e", smape_term("y", "p", strict))


def smape_by(pred: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Mean SMAPE per model and ``keys``."""
    return with_smape(pred, strict).groupBy("model", *keys).agg(F.avg("_e").alias("smape"))


def smape_by_horizon(pred: DataFrame) -> DataFrame:
    """Per model, the SMAPE of the first held-out period ('public') and
    the mean of the per-period SMAPEs of periods 2..4 ('private')."""
    per_date = smape_by(pred, ["t", "h"])
    return per_date.groupBy("model").agg(
        F.avg(F.when(F.col("h") == 1, F.col("smape"))).alias("public"),
        F.avg(F.when(F.col("h") > 1, F.col("smape"))).alias("private"))


def smape_macro(pred: DataFrame) -> DataFrame:
    """A10: mean over series of the per-series SMAPE, and mean over groups of
    the per-group SMAPE, per model."""
    # one pass: GROUPING SETS ((model, series), (model, state)), then the
    # two means per model from the tagged rows
    e = with_smape(pred)
    sets = (e.groupingSets([["model", "series"], ["model", "state"]], "model", "series", "state")
            .agg(F.avg("_e").alias("smape"), F.grouping("state").alias("_by_series")))
    return sets.groupBy("model").agg(
        F.avg(F.when(F.col("_by_series") == 1, F.col("smape"))).alias("mean_series_smape"),
        F.avg(F.when(F.col("_by_series") == 0, F.col("smape"))).alias("mean_group_smape"))


def smape_best_groups_mean(pred: DataFrame, n: int = C.BEST_GROUPS) -> DataFrame:
    """Mean of the ``n`` lowest per-group SMAPEs per model."""
    g = smape_by(pred, ["state"])
    # a group without a defined error ranks last, never among the best
    rk = F.row_number().over(Window.partitionBy("model").orderBy(
        F.col("smape").asc_nulls_last(), F.col("state")))
    return (g.select("*", rk.alias("_rk")).where(F.col("_rk") <= n)
            .groupBy("model").agg(F.avg("smape").alias("best_mean_smape"),
                                  F.count(F.lit(1)).alias("n_groups")))


def rmse_by(pred: DataFrame, keys: list[str]) -> DataFrame:
    """M8 grouped: ``sqrt(mean((y - p)^2))`` per model and keys."""
    return pred.groupBy("model", *keys).agg(
        F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2)).alias("rmse"))


def select_model(pred: DataFrame, model_order: list[str]) -> DataFrame:
    """Models ranked by mean per-series SMAPE (ties broken by the
    given model order); ``selected`` marks the best one.

    Models are compared on the same cells: those (series, t) for which each
    model with any defined error has one.  ``coverage`` is the share of its
    own cells that a model predicts, so a model cannot win by predicting only
    easy series unnoticed.  A model without a defined error ranks last; if no
    cell is common, every ``mean_smape`` is NULL and the order decides."""
    order = F.array_position(F.array(*[F.lit(m) for m in model_order]), F.col("model"))
    cell = Window.partitionBy("series", "t")
    known = F.when(F.col("_e").isNotNull(), F.col("model"))
    ensure_checkpoint_dir(pred.sparkSession)
    # read twice below: models and forecasts behind ``pred`` run once
    scored = with_smape(pred.select("model", "series", "t", "y", "p")).checkpoint(eager=True)
    able = scored.agg(F.count_distinct(known).alias("n")).first()["n"]
    marked = scored.withColumn("_all", F.size(F.collect_set(known).over(cell)) == able)
    per_series = marked.groupBy("model", "series").agg(
        F.avg(F.when(F.col("_all"), F.col("_e"))).alias("smape"),
        F.count("_e").alias("_known"), F.count(F.lit(1)).alias("_cells"))
    macro = per_series.groupBy("model").agg(
        F.avg("smape").alias("mean_smape"),
        (F.sum("_known") / F.sum("_cells")).alias("coverage"))
    # a model without a defined error ranks last, never selected first
    rk = F.row_number().over(Window.orderBy(F.col("mean_smape").asc_nulls_last(), F.col("_ord")))
    return (macro.withColumn("_ord", order.cast("int"))
            .select("model", "mean_smape", "coverage", rk.alias("rank"))
            .withColumn("selected", F.col("rank") == 1))
