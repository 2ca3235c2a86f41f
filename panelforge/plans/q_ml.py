"""Machine-learning and forecasting queries (slices 5-6).

``split_hash``, ``standardize`` and ``assemble_features`` have SQL oracles;
most model fits do not (the driver records rows-only checks, and the tests
check their properties).  Grids are the reference's.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import forecast as fc
from ..operators import joins
from ..operators import ml
from ..operators import windows as win
from ..session import scratch_path
from ..sources.tables import read_table
from . import fixtures as fx
from .catalog import register, rounded
from .q_evaluation import baseline_predictions

LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
LINE_LABEL = "l_extendedprice"
ATTR_FEATURES = ["x", "customers", "avg_acctbal", "share_automobile", "share_building",
                 "share_furniture", "share_household", "share_machinery", "suppliers", "supp_bal"]
SEQ_LEN = C.SEQUENCE_LENGTH
VALID = C.VALIDATION_LENGTH


def _lineitem(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem",
                      ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                       "l_discount", "l_tax"])


@register("split_hash", """
SELECT l_orderkey, l_linenumber,
       CAST(CAST(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 8)) AS BIGINT) % 100 AS INTEGER) AS bucket,
       CASE WHEN CAST(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 70
            THEN 'train' ELSE 'test' END AS split
FROM lineitem
""")
def q_split_hash(spark, sf_dir):
    li = _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber")
    return ml.hash_split(li, ["l_orderkey", "l_linenumber"])


@register("standardize", """
SELECT l_orderkey, l_linenumber,
       round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS z_l_quantity,
       round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), 6) AS z_l_extendedprice,
       round((l_discount - avg(l_discount) OVER ()) / stddev_samp(l_discount) OVER (), 6) AS z_l_discount,
       round((l_tax - avg(l_tax) OVER ()) / stddev_samp(l_tax) OVER (), 6) AS z_l_tax
FROM lineitem
""")
def q_standardize(spark, sf_dir):
    li = _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity",
                                         "l_extendedprice", "l_discount", "l_tax")
    out = ml.standardize(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(out.drop("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def _attr_panel(spark, sf_dir) -> DataFrame:
    joined = joins.panel_attr_join(fx.panel(spark, sf_dir), fx.attributes(spark, sf_dir))
    return joined.withColumn("x", ((F.year("t") - 2019) * 12 + F.month("t") - 8).cast("int"))


@register("assemble_features", """
SELECT p.series, p.t, CAST(5 AS INTEGER) AS n_features,
       CAST((year(p.t) - 2019) * 12 + month(p.t) - 8 AS DOUBLE) AS f_x,
       CAST(a.customers AS DOUBLE) AS f_customers, round(a.avg_acctbal, 6) AS f_avg_acctbal,
       CAST(a.suppliers AS DOUBLE) AS f_suppliers, round(a.avg_funded_bal, 6) AS f_avg_funded_bal
FROM panel p JOIN attrs a ON p.series = a.series
WHERE a.avg_funded_bal IS NOT NULL
""")
def q_assemble_features(spark, sf_dir):
    feats = ["x", "customers", "avg_acctbal", "suppliers", "avg_funded_bal"]
    data = ml.assemble(_attr_panel(spark, sf_dir), feats, "features", "skip")
    arr = F.col("_a")
    out = data.select("series", "t", vector_to_array("features").alias("_a"))
    return rounded(out.select("series", "t", F.size(arr).alias("n_features"),
                              *[arr[i].alias(f"f_{c}") for i, c in enumerate(feats)]))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    data = _attr_panel(spark, sf_dir)
    return rounded(ml.feature_importance(data, ATTR_FEATURES, "density",
                                         layout_keys=["series", "t"], train_pct=C.TRAIN_PERCENT))


def pca_sql(cov: str) -> str:
    """Scree table of the covariance matrix ``cov`` (i, j, v from 0; an even
    number of rows): Jacobi rotations, all disjoint pairs of a round at once
    (round-robin pairing), ten sweeps, as a recursive CTE over the matrix as a
    list."""
    at = lambda i, j: f"a[({i}) * d + ({j}) + 1]"
    low, high = "least(i, p.w[i + 1])", "greatest(i, p.w[i + 1])"
    tau = f"(({at(high, high)} - {at(low, low)}) / (2 * {at(low, high)}))"
    own = lambda i: f"r.co[{i} + 1]"
    other = lambda i: f"r.sg[{i} + 1]"
    with_ = lambda i: f"p.w[{i} + 1]"
    i, j = "(x // d)", "(x % d)"
    return f"""
jac AS (
  SELECT 0 AS step, (SELECT list(v ORDER BY i, j) FROM {cov}) AS a, (SELECT CAST(max(i) + 1 AS BIGINT) FROM {cov}) AS d
  UNION ALL
  SELECT step + 1, list_transform(range(0, d * d), lambda x:
           {own(i)} * {own(j)} * {at(i, j)} + {other(i)} * {own(j)} * {at(with_(i), j)}
           + {own(i)} * {other(j)} * {at(i, with_(j))} + {other(i)} * {other(j)} * {at(with_(i), with_(j))}), d
  FROM jac,
  LATERAL (SELECT list_transform(range(0, d), lambda i: CASE
             WHEN i = d - 1 THEN step % (d - 1) WHEN i = step % (d - 1) THEN d - 1
             ELSE (2 * (step % (d - 1)) - i + 2 * (d - 1)) % (d - 1) END) AS w) p,
  LATERAL (SELECT list_transform(range(0, d), lambda i: CASE WHEN {at(low, high)} = 0 THEN 0.0 ELSE
             (CASE WHEN {tau} >= 0 THEN 1.0 ELSE -1.0 END) / (abs({tau}) + sqrt(1 + {tau} * {tau})) END) AS t) tan,
  LATERAL (SELECT list_transform(tan.t, lambda t: 1 / sqrt(1 + t * t)) AS co,
                  list_transform(range(0, d), lambda i: (CASE WHEN i < p.w[i + 1] THEN -1 ELSE 1 END) * tan.t[i + 1]
                                                        / sqrt(1 + tan.t[i + 1] * tan.t[i + 1])) AS sg) r
  WHERE step < 10 * (d - 1)
),
eigen AS (
  SELECT unnest(list_transform(range(0, d), lambda i: a[i * d + i + 1])) AS e
  FROM jac WHERE step = 10 * (d - 1)
),
scree AS (
  SELECT CAST(row_number() OVER (ORDER BY e DESC) AS INTEGER) AS k, e / sum(e) OVER () AS explained FROM eigen
)
SELECT k, round(explained, 6) AS explained, round(sum(explained) OVER (ORDER BY k), 6) AS cumulative,
       sum(explained) OVER (ORDER BY k) >= {C.PCA_CUTOFF} AS reaches_cutoff
FROM scree WHERE k <= {C.PCA_MAX_COMPONENTS}
"""


@register("pca_scree", """WITH RECURSIVE cell AS (
  SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings
), cov AS (
  SELECT a.i, b.i AS j, covar_samp(CAST(a.x AS DOUBLE), CAST(b.x AS DOUBLE)) AS v
  FROM cell a JOIN cell b ON a.vec_id = b.vec_id GROUP BY a.i, b.i
),""" + pca_sql("cov"))
def q_pca_scree(spark, sf_dir):
    emb = ml.embeddings_vectors(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
    return rounded(ml.pca_scree(emb, vector_col="vec"))


_ATTR_VALUES = ", ".join("CAST((year(p.t) - 2019) * 12 + month(p.t) - 8 AS DOUBLE)" if c == "x" else f"CAST(a.{c} AS DOUBLE)"
                         for c in ATTR_FEATURES)


@register("pca_scree_features", f"""WITH RECURSIVE vecs AS (
  SELECT p.series, p.t, [{_ATTR_VALUES}] AS f FROM panel p JOIN attrs a ON p.series = a.series
), cell AS (
  SELECT series, t, unnest(f) AS x, unnest(range(0, {len(ATTR_FEATURES)})) AS i FROM vecs
  WHERE len(list_filter(f, lambda v: v IS NULL)) = 0
), dev AS (SELECT i, stddev_samp(x) AS sd FROM cell GROUP BY i),
cov AS (
  SELECT a.i, b.i AS j, CASE WHEN any_value(s.sd) = 0 OR any_value(u.sd) = 0 THEN 0.0
                             ELSE covar_samp(a.x, b.x) / any_value(s.sd) / any_value(u.sd) END AS v
  FROM cell a JOIN cell b ON a.series = b.series AND a.t = b.t JOIN dev s ON s.i = a.i JOIN dev u ON u.i = b.i
  GROUP BY a.i, b.i
),""" + pca_sql("cov"))
def q_pca_scree_features(spark, sf_dir):
    """M5 on the reference's kind of input: the feature matrix of the
    panel-attribute join (attributes + month index), standardised first."""
    data = _attr_panel(spark, sf_dir).na.drop("any", subset=ATTR_FEATURES)
    return rounded(ml.pca_scree(data, features=ATTR_FEATURES, standardize_first=True))


def _cv_inputs(spark, sf_dir):
    """(name, table, features, label, keys): ``lineitem`` and the reference's
    kind of input, the panel-attribute table."""
    panel = _attr_panel(spark, sf_dir).where(F.col("density").isNotNull())
    return [("lineitem", _lineitem(spark, sf_dir), LINE_FEATURES, LINE_LABEL, ["l_orderkey", "l_linenumber"]),
            ("panel_attributes", panel.select("series", "t", *ATTR_FEATURES, "density"), ATTR_FEATURES, "density",
             ["series", "t"])]


def _grid_cv(spark, sf_dir, grid) -> DataFrame:
    """Cross-validation of every map on both inputs, one after the other (each
    keeps the cores busy by itself); ``input`` names the table."""
    def scored(name, data, features, label, keys):
        out = grid(data, features, label, keys, folds=C.CV_FOLDS, seed=C.RF_SEED)
        return out.select(F.lit(name).alias("input"), "*")

    parts = [scored(*i) for i in _cv_inputs(spark, sf_dir)]
    return rounded(parts[0].unionByName(parts[1]))


@register("rf_cv")
def q_rf_cv(spark, sf_dir):
    return _grid_cv(spark, sf_dir, ml.forest_grid)


@register("gbt_cv")
def q_gbt_cv(spark, sf_dir):
    return _grid_cv(spark, sf_dir, ml.boosted_grid)


@register("cv_folds", """
WITH line AS (
  SELECT 'lineitem' AS input, CAST(l_extendedprice AS DOUBLE) AS y,
         CAST(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 8)) AS BIGINT) % 100 AS bucket
  FROM lineitem
  WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_extendedprice IS NOT NULL
), merged AS (
  SELECT 'panel_attributes' AS input, p.density AS y,
         CAST(('0x' || substr(md5(CAST(p.series AS VARCHAR) || '|' || CAST(p.t AS VARCHAR)), 1, 8)) AS BIGINT) % 100 AS bucket
  FROM panel p JOIN attrs a ON p.series = a.series
  WHERE p.density IS NOT NULL AND a.customers IS NOT NULL AND a.avg_acctbal IS NOT NULL AND a.suppliers IS NOT NULL
    AND a.supp_bal IS NOT NULL
), cells AS (
  SELECT input, y, CASE WHEN bucket < 70 THEN 'train' ELSE 'test' END AS split,
         CASE WHEN bucket < 70 THEN CAST(bucket % 2 AS INTEGER) END AS fold
  FROM (SELECT * FROM line UNION ALL SELECT * FROM merged)
), g AS (
  SELECT input, split, fold, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM cells GROUP BY 1, 2, 3
), m AS (
  SELECT g.*, (SELECT sum(o.s) / sum(o.n) FROM g o
               WHERE o.input = g.input AND o.split = 'train' AND (g.fold IS NULL OR o.fold <> g.fold)) AS mu
  FROM g
)
SELECT input, split, fold, n AS n_rows, round(mu, 6) AS train_mean,
       round(sqrt(greatest(ss / n - 2 * mu * s / n + mu * mu, 0)), 4) AS mean_rmse
FROM m
""")
def q_cv_folds(spark, sf_dir):
    """Sizes of the splits and folds of ``rf_cv`` and ``gbt_cv``, and the error
    of the mean of the rows that a fold is validated against."""
    parts = [ml.fold_baseline(data.na.drop("any", subset=[*features, label]), label, keys)
             .select(F.lit(name).alias("input"), "*") for name, data, features, label, keys in _cv_inputs(spark, sf_dir)]
    return rounded(parts[0].unionByName(parts[1])).withColumn("mean_rmse", F.round("mean_rmse", 4))


# ------------------------------------------------------- panel forecasting
def _windows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(train windows, valid windows) of the zero-repaired appended panel: a
    window trains when its target precedes the hold-out periods.  The
    flattened window table (panel-sized) is checkpointed once per session,
    because every model fit and search trial reads it again, in partitions
    whose number follows from the rows, sorted by key: a seeded fit sees the
    same layout on any cluster."""
    def build():
        repaired = win.zero_series_repair(fx.appended(spark, sf_dir))
        hold = fx.holdout(spark, sf_dir, VALID)
        seq = win.sequence_windows(repaired, length=SEQ_LEN, extra=("county", "state"))
        seq = ml.flatten_windows(seq, SEQ_LEN).join(F.broadcast(hold), "t", "left")
        seq = ml.add_series_encoding(seq, seq.where(F.col("h").isNull()))
        # from the rows alone: seeded fits must not change with the cluster
        n_parts = max(1, -(-fx.panel(spark, sf_dir).count() // fx.PANEL_ROWS_PER_PARTITION))
        # kept by column beside the checkpoint: fits read it again and again,
        # and a checkpoint gives back whole rows, one object each
        return (ml.stable_layout(seq, ["series", "t"], n_parts).checkpoint(eager=True)
                .persist(StorageLevel.MEMORY_AND_DISK))
    marked = fx._memoized(spark, ("windows", sf_dir), build)
    train = marked.where(F.col("h").isNull()).drop("h")
    valid = marked.where(F.col("h").isNotNull())
    return train, valid


def _recursive_state(spark, sf_dir) -> DataFrame:
    """Per series, the last SEQ_LEN known values before the hold-out (oldest
    first) and its encoding; a series with fewer of them keeps its row and is
    not forecast.  Checkpointed once for all models."""
    def build():
        repaired = win.zero_series_repair(fx.appended(spark, sf_dir))
        hold = fx.holdout(spark, sf_dir, VALID)
        hist = repaired.join(F.broadcast(hold), "t", "left_anti")
        ids = hist.select("series", "county", "state").distinct()
        hist = hist.where(F.col("density").isNotNull())
        last = win.last_values(hist, "density", SEQ_LEN, extra=("county", "state"))
        x = last.groupBy("series").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("t", "density"))), lambda s: s["density"]).alias("x"))
        state = ids.join(x, "series", "left")
        return ml.add_series_encoding(state, _windows(spark, sf_dir)[0]).checkpoint(eager=True)
    return fx._memoized(spark, ("state", sf_dir), build)


@register("gbt_early_stop")
def q_gbt_early_stop(spark, sf_dir):
    train, valid = _windows(spark, sf_dir)
    feats = ml.lag_features(SEQ_LEN)
    model, data = ml.gbt_early_stop(train.select(*feats, "target", "series", "t"),
                                    valid.select(*feats, "target", "series", "t"), feats, "target",
                                    max_iter=100, tol=0.001, layout_keys=["series", "t"])
    scored = model.transform(data.where("_is_valid"))
    rmse = F.sqrt(F.avg((F.col("target") - F.col("prediction")) ** 2))
    return rounded(scored.agg(F.lit(model.getNumTrees).alias("trees_used"),
                              F.lit(100).alias("max_iter"), rmse.alias("valid_rmse")))


@register("gbt_keep_best")
def q_gbt_keep_best(spark, sf_dir):
    """The validation curve, the iteration it keeps, and the error of
    the kept model after saving and loading it."""
    train, valid = _windows(spark, sf_dir)
    feats = ml.lag_features(SEQ_LEN)
    model, curve = ml.gbt_keep_best(train, valid, feats, "target", max_iter=100, layout_keys=["series", "t"])
    path = scratch_path(spark, "kept-model")
    model.write().save(path)
    scored = GBTRegressionModel.load(path).transform(ml.assemble(valid, feats))
    rmse = scored.agg(F.sqrt(F.avg((F.col("target") - F.col("prediction")) ** 2)).alias("r")).first()["r"]
    best = curve.index(min(curve))
    rows = [(i + 1, v, i == best, rmse if i == best else None) for i, v in enumerate(curve)]
    return rounded(spark.createDataFrame(rows, "iteration int, valid_rmse double, kept boolean, reloaded_rmse double"))


@register("huber_ar")
def q_huber_ar(spark, sf_dir):
    train, _ = _windows(spark, sf_dir)
    model = ml.pooled_ar_pipeline("huber", SEQ_LEN).fit(train)
    rows = ml.huber_coefficients(model, SEQ_LEN)
    return rounded(spark.createDataFrame(rows, "term string, coefficient double"))


@register("param_search")
def q_param_search(spark, sf_dir):
    """Seeded random search over model settings, scored by SMAPE on the
    last VALID months (time-ordered).  Like the reference's tuner the space
    switches the series and group encodings on and off, draws the size of the
    series' embedding (factors of the training months; 1 is the mean) and the L2
    factor from their choice lists; the model is the Huber-loss regression."""
    windows = _windows(spark, sf_dir)
    factors = ml._at_once([lambda r=rank: ml.series_factors(windows[0], r).checkpoint(eager=True)
                           for rank in C.SERIES_FACTORS], len(C.SERIES_FACTORS))

    def prepared(rows, name):
        rows = rows.select("series", "state", "target", "series_te", *ml.lag_features(SEQ_LEN))
        for rank, found in zip(C.SERIES_FACTORS, factors):
            rows = ml.add_series_factors(rows, found, rank, out=f"series_{rank}")
        return ml.columnar(rows, scratch_path(spark, name))
    train, valid = (prepared(d, n) for d, n in zip(windows, ("search-train", "search-valid")))
    space = {"use_county": [True, False], "use_state": [True, False], "county_size": [1, *C.SERIES_FACTORS],
             "l2": list(C.L2_CHOICES), "epsilon": [1.35, 2.0, 3.0]}

    columns = {1: "series_te"} | {rank: f"series_{rank}" for rank in C.SERIES_FACTORS}

    def build(s):
        return ml.pooled_ar_pipeline("huber", SEQ_LEN,
                                     group_col="state" if s["use_state"] else None,
                                     series_col=columns[s["county_size"]] if s["use_county"] else None,
                                     reg_param=s["l2"], epsilon=s["epsilon"])
    return rounded(ml.random_search_pipelines(train, valid, build, space, n_trials=C.SEARCH_TRIALS,
                                              label="target", seed=C.GLOBAL_SEED))


@register("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    train, valid = _windows(spark, sf_dir)
    model = ml.pooled_ar_pipeline("linear", SEQ_LEN).fit(train)
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    a = model.transform(valid).select("series", "t", F.col("prediction").alias("p_fit"))
    b = loaded.transform(valid).select("series", "t", F.col("prediction").alias("p_loaded"))
    return rounded(a.join(b, ["series", "t"]).withColumn(
        "same", F.abs(F.col("p_fit") - F.col("p_loaded")) < 1e-9))


POOLED_KINDS = ("rf", "gbt", "huber")
LEAST_FIT_TASKS = 24                # of a fit without draws, if the windows have as many partitions
FIT_PARTITIONS_PER_TASK = 25        # and above: half a million rows


def pooled_model(spark, sf_dir, kind: str) -> PipelineModel:
    train, _ = _windows(spark, sf_dir)
    if kind == "huber":
        # a job per step and no draws: fewer, larger tasks once there are many
        n = train.rdd.getNumPartitions()
        train = train.coalesce(max(min(n, LEAST_FIT_TASKS), -(-n // FIT_PARTITIONS_PER_TASK)))
    return ml.pooled_ar_pipeline(kind, SEQ_LEN, series_col="series_te").fit(train)


def pooled_models(spark, sf_dir) -> dict[str, PipelineModel]:
    """The models of all kinds, fitted at the same time: each is a row of
    short jobs that leave cores idle."""
    _windows(spark, sf_dir)
    fits = [lambda k=k: pooled_model(spark, sf_dir, k) for k in POOLED_KINDS]
    return dict(zip(POOLED_KINDS, ml._at_once(fits, len(fits))))


def one_step_predictions(spark, sf_dir, kind: str) -> DataFrame:
    """One step ahead: the window's own target is the actual value."""
    _, valid = _windows(spark, sf_dir)
    return pooled_model(spark, sf_dir, kind).transform(valid).select(
        F.lit(f"pooled_{kind}").alias("model"), "series", "state", "t", "h",
        F.col("target").alias("y"), F.col("prediction").alias("p"))


def recursive_predictions(spark, sf_dir, kind: str, model: PipelineModel) -> DataFrame:
    """Recursive 4-step forecasts of a pooled model, in the prediction layout
    of ``operators.forecast`` (with the actual ``y``)."""
    def build():
        repaired = win.zero_series_repair(fx.appended(spark, sf_dir))
        held = repaired.join(F.broadcast(fx.holdout(spark, sf_dir, VALID)), "t", "left_semi")
        return held.select("series", "t", F.col("density").alias("y")).checkpoint(eager=True)
    actual = fx._memoized(spark, ("actual", sf_dir), build)     # of the held-out months, once for all models
    pred = ml.recursive_forecast(model, _recursive_state(spark, sf_dir), fx.holdout(spark, sf_dir, VALID),
                                 VALID, SEQ_LEN, f"pooled_{kind}")
    return pred.join(actual, ["series", "t"]).select(*fc.PRED_COLS)


@register("pooled_ar_forecast")
def q_pooled_ar_forecast(spark, sf_dir):
    """One-step-ahead (teacher-forced) predictions of the pooled RF model."""
    return rounded(one_step_predictions(spark, sf_dir, "rf"))


@register("backtest_recursive")
def q_backtest_recursive(spark, sf_dir):
    return rounded(recursive_predictions(spark, sf_dir, "rf", pooled_model(spark, sf_dir, "rf")))


@register("backtest_select_all")
def q_backtest_select_all(spark, sf_dir):
    preds = baseline_predictions(spark, sf_dir)
    for kind, model in pooled_models(spark, sf_dir).items():
        preds = preds.unionByName(recursive_predictions(spark, sf_dir, kind, model))
    order = ["persistence", "seasonal_naive"] + [f"pooled_{k}" for k in POOLED_KINDS]
    out = fc.select_model(preds, order)
    return rounded(out.withColumn("rank", F.col("rank").cast("int")))


@register("best_model_saved")
def q_best_model_saved(spark, sf_dir):
    """S8/T14 end to end: fit the pooled models, save each one, select the best
    by backtest, load that one again and return its errors per series."""
    base, order, preds = scratch_path(spark, "models"), [f"pooled_{k}" for k in POOLED_KINDS], None
    for kind, model in pooled_models(spark, sf_dir).items():
        model.write().save(f"{base}/pooled_{kind}")
        pred = recursive_predictions(spark, sf_dir, kind, model)
        preds = pred if preds is None else preds.unionByName(pred)
    best = fc.select_model(preds, order).where("selected").first()["model"]
    loaded = PipelineModel.load(f"{base}/{best}")
    return rounded(fc.smape_by(recursive_predictions(spark, sf_dir, best.removeprefix("pooled_"), loaded),
                               ["series"]))
