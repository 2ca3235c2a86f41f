"""Spark ML workflows (inventory M1-M16, T12-T14).

Fits are Spark ML estimators over DataFrames: the data stays on the
executors, only models (a few trees, a d x d covariance, coefficient
vectors) reach the driver.  Inputs are laid out deterministically
(``stable_layout``) before tree fits, because a seeded fit still depends
on how rows are partitioned.  Row splits use a key hash, not
``randomSplit``, so they do not change with partitioning either.
"""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.exprs import hash_percent, smape_term
from ..session import scratch_path
from . import cells as cl
from . import forest


# ------------------------------------------------------------------ helpers
def stable_layout(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Hash-partition by ``keys`` and sort within partitions, so a seeded fit
    sees the same rows in the same tasks whatever the input layout was.
    Without an explicit count AQE sizes the partitions from the data (its
    coalescing is a deterministic function of the shuffle statistics)."""
    parted = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return parted.sortWithinPartitions(*keys)


def columnar(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again by column: each of many fits
    on one wide table reads only the columns of its own model."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_split(df: DataFrame, keys: list[str], train_pct: int = C.TRAIN_PERCENT,
               out: str = "split") -> DataFrame:
    """M3: 'train' for rows whose key hash bucket (0..99) is below
    ``train_pct``, else 'test'.  Partition- and order-invariant."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if len(keys) > 1 else F.col(keys[0])
    bucket = hash_percent(key)
    return df.withColumn("bucket", bucket).withColumn(
        out, F.when(F.col("bucket") < train_pct, F.lit("train")).otherwise(F.lit("test")))


def assemble(df: DataFrame, features: list[str], out: str = "features",
             handle_invalid: str = "skip") -> DataFrame:
    """M1: dense feature vector from an explicit column list.  Rows with a
    NULL feature are skipped (``handle_invalid='skip'``) or fail
    (``'error'``)."""
    return VectorAssembler(inputCols=features, outputCol=out,
                           handleInvalid=handle_invalid).transform(df)


def standardize(df: DataFrame, features: list[str], prefix: str = "z_") -> DataFrame:
    """M2: (x - mean) / sample std per column; a constant column gives 0 and
    rows with a NULL feature are dropped (as the assembler does).

    The 2 x d moments come from one aggregate (partial aggregation on every
    task, 2d numbers to the driver); the scaling itself is a plain codegen
    projection, so no vector is built per row."""
    data = df.na.drop("any", subset=features)
    stats = data.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
                     *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    cols = []
    for i, c in enumerate(features):
        m, sd = stats[f"m{i}"], stats[f"s{i}"]
        if m is None or sd is None or sd == 0 or sd != sd:
            z = F.lit(0.0)
        else:
            z = (F.col(c) - F.lit(m)) / F.lit(sd)
        cols.append(z.alias(prefix + c))
    return data.select(*df.columns, *cols)


def standard_scaler(df: DataFrame, features: list[str], out: str = "scaled"):
    """M2 as a fitted Spark ML stage (for pipelines): assembler + scaler with
    mean and std; returns (model, transformed DataFrame)."""
    data = assemble(df, features, "_f")
    model = StandardScaler(inputCol="_f", outputCol=out, withMean=True, withStd=True).fit(data)
    return model, model.transform(data)


def feature_columns_checked(features: list[str], label: str) -> list[str]:
    if label in features:
        raise ValueError(f"label {label!r} is in the feature list")
    return list(features)


# ------------------------------------------------------- importance and PCA
def feature_importance(df: DataFrame, features: list[str], label: str,
                       num_trees: int = C.RF_NUM_TREES, max_depth: int = C.RF_MAX_DEPTH,
                       seed: int = C.RF_SEED, layout_keys: list[str] | None = None,
                       train_pct: int | None = None, bins: int = C.RF_BINS) -> DataFrame:
    """M4: random-forest importances by feature name, descending (sum 1).
    With ``train_pct`` the forest is fit on that share of rows (hash split
    on ``layout_keys``), as the reference fits on a 70 % split.  The rows'
    bootstrap follows a hash of ``layout_keys`` (of all columns if not given),
    so the result does not depend on the layout (see ``operators.forest``)."""
    features = feature_columns_checked(features, label)
    if train_pct is not None:
        if not layout_keys:
            raise ValueError("train_pct needs layout_keys to hash")
        df = hash_split(df, layout_keys, train_pct).where(F.col("split") == "train")
    data = forest.prepared(df, features, label, layout_keys or [*features, label]).checkpoint(eager=True)
    imp = forest.fit_forest(data, len(features), num_trees, max_depth, bins, seed).importances().tolist()
    spark = df.sparkSession
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    out = spark.createDataFrame(rows, "feature string, importance double")
    rk = F.row_number().over(Window.orderBy(F.col("importance").desc(), F.col("feature")))
    return out.select("feature", "importance", rk.cast("int").alias("rank"))


def pca_scree(df: DataFrame, vector_col: str | None = None, features: list[str] | None = None,
              k: int = C.PCA_MAX_COMPONENTS, standardize_first: bool = False,
              cutoff: float = C.PCA_CUTOFF) -> DataFrame:
    """One PCA fit with k components; explained variance ratio per
    component, its running sum, and whether the running sum has reached the
    cut-off.  The prefix of a k-component fit equals the smaller fits."""
    if vector_col is None:
        data = assemble(df, features, "_v")
        vector_col = "_v"
    else:
        data = df
    d = len(data.select(vector_col).first()[0]) if features is None else len(features)
    k = min(k, d)
    if standardize_first:
        data = StandardScaler(inputCol=vector_col, outputCol="_s", withMean=True,
                              withStd=True).fit(data).transform(data)
        vector_col = "_s"
    model = PCA(k=k, inputCol=vector_col, outputCol="_p").fit(data)
    ev = model.explainedVariance.toArray().tolist()
    spark = df.sparkSession
    out = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(ev)],
                                "k int, explained double")
    cum = F.sum("explained").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return out.select("k", "explained", cum.alias("cumulative")).withColumn(
        "reaches_cutoff", F.col("cumulative") >= F.lit(cutoff))


def embeddings_vectors(emb: DataFrame, col: str = "embedding") -> DataFrame:
    return emb.select("vec_id", array_to_vector(F.col(col).cast("array<double>")).alias("vec"))


# ------------------------------------------------------ cross-validation
def _cv_rows(cv_model, param_names: list[str], metric: str = "rmse") -> tuple[list, str]:
    """One row per parameter map with its mean cross-validated metric."""
    rows = []
    for pm, m in zip(cv_model.getEstimatorParamMaps(), cv_model.avgMetrics):
        named = {p.name: v for p, v in pm.items()}
        rows.append(tuple(float(named[n]) for n in param_names) + (float(m),))
    schema = ", ".join(f"{n} double" for n in param_names) + f", avg_{metric} double"
    return rows, schema


def cross_validate(df: DataFrame, estimator, grid, features: list[str], label: str,
                   folds: int = C.CV_FOLDS, seed: int = C.SPLIT_SEED,
                   train_pct: int = C.TRAIN_PERCENT,
                   split_keys: list[str] | None = None, parallelism: int = 2,
                   requested: list[dict] | None = None) -> DataFrame:
    """Hash split into train/test, k-fold CV over ``grid`` on
    train (best model refit on all train), hold-out RMSE on test.  Returns
    the CV table with the hold-out RMSE and a ``best`` flag.  ``requested``
    has, per map, the values asked for where Spark cannot take them; they are
    reported as columns ``requested_<param>``."""
    features = feature_columns_checked(features, label)
    keys = split_keys or features
    data = hash_split(assemble(df, features), keys, train_pct)
    # Folds by a hash of the keys: the same rows meet in a fold whatever the
    # partition layout or the number of cores.
    fold = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(folds)).cast("int")
    train = data.where(F.col("split") == "train").withColumn("_fold", fold)
    test = data.where(F.col("split") == "test")
    evaluator = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="rmse")
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator,
                        numFolds=folds, seed=seed, parallelism=parallelism, foldCol="_fold")
    model = cv.fit(train)
    holdout = evaluator.evaluate(model.transform(test))
    names = sorted({p.name for pm in grid for p in pm})
    rows, schema = _cv_rows(model, names)
    best = int(np.argmin(model.avgMetrics))
    rows = [r + (float(holdout), i == best) for i, r in enumerate(rows)]
    schema += ", holdout_rmse double, best boolean"
    for n in sorted({n for asked in requested or [] for n in asked}):
        rows = [r + (float(asked[n]),) for r, asked in zip(rows, requested)]
        schema += f", requested_{n} double"
    return df.sparkSession.createDataFrame(rows, schema)


def split_and_folds(df: DataFrame, keys: list[str], folds: int = C.CV_FOLDS,
                    train_pct: int = C.TRAIN_PERCENT) -> DataFrame:
    """M3/M6: ``split`` by key hash, and for training rows the ``fold`` (0 ..
    folds - 1, NULL for test rows) by the same hash."""
    fold = F.when(F.col("split") == "train", F.col("bucket") % F.lit(folds)).cast("int")
    return hash_split(df, keys, train_pct).withColumn("fold", fold)


def fold_baseline(df: DataFrame, label: str, keys: list[str], folds: int = C.CV_FOLDS) -> DataFrame:
    """``split``, ``fold``, ``n_rows``, ``train_mean`` (of the other folds'
    training rows; of all of them for the test split) and the RMSE of that mean.
    One aggregate to folds + 1 rows."""
    y = F.col(label).cast("double")
    g = split_and_folds(df, keys, folds).groupBy("split", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"))
    all_ = Window.partitionBy()
    train = F.col("split") == "train"
    total = lambda c: F.sum(F.when(train, F.col(c)).otherwise(0)).over(all_)
    own = lambda c: F.when(train, F.col(c)).otherwise(0)
    mu = (total("s") - own("s")) / (total("n") - own("n"))
    out = g.select("split", "fold", F.col("n").alias("n_rows"), mu.alias("train_mean"), "s", "ss", "n")
    mse = F.col("ss") / F.col("n") - 2 * F.col("train_mean") * F.col("s") / F.col("n") + F.col("train_mean") ** 2
    return out.select("split", "fold", "n_rows", "train_mean", F.sqrt(F.greatest(mse, F.lit(0.0))).alias("mean_rmse"))


def _at_once(jobs: list, parallelism: int) -> list:
    """Results of functions that each run Spark jobs, a few at a time."""
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        return pool.map(lambda job: job(), jobs)


def _grid_rows(spark, names: list[str], maps: list[tuple], mse: list[dict], holdout, requested=None) -> DataFrame:
    """One row per map: its parameters, the mean over the folds of their RMSE,
    the hold-out RMSE of the best map (refit on all training rows), ``best``."""
    avg = [float(np.mean([math.sqrt(m[p]) if p in m else math.nan for m in mse])) for p in maps]
    best = int(np.nanargmin(avg)) if np.isfinite(avg).any() else 0
    held = holdout(maps[best])
    schema = ", ".join(f"{n} double" for n in names) + ", avg_rmse double, holdout_rmse double, best boolean"
    rows = [(*map(float, p), a, held, i == best) for i, (p, a) in enumerate(zip(maps, avg))]
    if requested:
        rows = [(*r, float(q)) for r, q in zip(rows, requested)]
        schema += ", requested_maxDepth double"
    return spark.createDataFrame(rows, schema)


def forest_grid(df: DataFrame, features: list[str], label: str, keys: list[str], grid: dict = C.RF_GRID,
                folds: int = C.CV_FOLDS, seed: int = C.RF_SEED, train_pct: int = C.TRAIN_PERCENT,
                parallelism: int = 6) -> DataFrame:
    """Random forests over every map of ``grid`` (``maxBins``,
    ``maxDepth``, ``numTrees``), cross-validated on the training split.

    Forests are nested (``operators.forest``): one growth per number of bins
    and fold, to the most trees and the greatest depth, holds the forests of
    all other maps, whose errors come from one pass.  They grow over the rows'
    cells (``operators.cells``), all numbers of bins and folds from one draw of
    each row's weights; with too many cells they grow level by level over rows."""
    features = feature_columns_checked(features, label)
    data = forest.prepared(split_and_folds(df, keys, folds, train_pct), features, label, keys,
                           ("split", "fold")).checkpoint(eager=True)
    # few files: enough tasks for the rows (the forest is the same on any layout)
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, -(-data.count() // forest.CHUNK_ROWS))
    if data.rdd.getNumPartitions() < tasks:
        data = data.repartition(tasks).checkpoint(eager=True)
    train, d = data.where(F.col("split") == "train"), len(features)
    depths, counts = sorted(grid["maxDepth"]), sorted(grid["numTrees"])
    maps = [(b, depth, n) for n in grid["numTrees"] for depth in grid["maxDepth"] for b in grid["maxBins"]]
    names = ["maxBins", "maxDepth", "numTrees"]
    over_cells = cl.forest_grid_errors(data, d, grid["maxBins"], depths, counts, folds, seed)
    if over_cells:
        return _grid_rows(df.sparkSession, names, maps, *over_cells)

    def fold_errors(bins, fold):
        grown = forest.fit_forest(train.where(F.col("fold") != fold), d, counts[-1], depths[-1], bins, seed)
        found = forest.squared_errors(train.where(F.col("fold") == fold), grown, depths, counts)
        return fold, {(bins, depth, n): mse for (depth, n), mse in found.items()}

    jobs = [lambda b=b, f=f: fold_errors(b, f) for b in grid["maxBins"] for f in range(folds)]
    mse = [{} for _ in range(folds)]
    for fold, found in _at_once(jobs, parallelism):
        mse[fold] |= found

    def holdout(best):
        bins, depth, n = best
        grown = forest.fit_forest(train, d, n, depth, bins, seed)
        found = forest.squared_errors(data.where(F.col("split") == "test"), grown, [depth], [n])
        return math.sqrt(found[depth, n]) if found else None

    return _grid_rows(df.sparkSession, names, maps, mse, holdout)


def staged_errors(model, data: DataFrame) -> list[float]:
    """Mean squared error on ``data`` after each iteration of a boosted model,
    from one pass: entry i - 1 is that of the model of i iterations."""
    return model.evaluateEachIteration(data, "squared")


def boosted_grid(df: DataFrame, features: list[str], label: str, keys: list[str], grid: dict = C.GBT_GRID,
                 folds: int = C.CV_FOLDS, seed: int = C.RF_SEED, train_pct: int = C.TRAIN_PERCENT,
                 parallelism: int = 8) -> DataFrame:
    """Boosted trees over every map of ``grid`` (``maxBins``,
    ``maxDepth``, ``maxIter``), cross-validated on the training split.

    The trees of a sequence do not depend on its length, so one fit per depth,
    number of bins and fold, of the most iterations, holds all shorter ones.
    Sequences grow over the rows' cells (``operators.cells``) with Spark ML's
    thresholds, one to a task; with too many cells Spark ML fits them over rows.
    Depths above Spark's maximum grow to it; ``requested_maxDepth`` shows what
    was asked for.  Once deep trees have used up what the bins can tell apart,
    residuals are rounding; splits on them (gain below ``LEAST_INFO_GAIN``) are
    not made."""
    features, spark = feature_columns_checked(features, label), df.sparkSession
    columns = [f"f_{i}" for i in range(len(features))]
    data = split_and_folds(df, keys, folds, train_pct).na.drop("any", subset=[label, *features]).select(
        *[F.col(c).cast("double").alias(f) for c, f in zip(features, columns)], F.col(label).cast("double").alias("y"),
        F.coalesce("fold", F.lit(-1)).alias("part")).checkpoint(eager=True)
    train = data.where(F.col("part") >= 0)
    rows = {r["part"]: r["count"] for r in data.groupBy("part").count().collect()}
    others = [[p for p in range(folds) if p != f] for f in range(folds)]

    def edges(name, parts):
        kept = train if name == "all" else train.where(F.col("part") != name)
        found = cl.spark_edges(kept, sum(rows.get(p, 0) for p in parts), len(features), grid["maxBins"], seed)
        return {(name, b): e for b, e in found.items()}

    known = None
    if all(sum(rows.get(p, 0) for p in parts) for parts in others):
        sets = [*enumerate(others), ("all", [*range(folds)])]
        known = cl.count_cells(data, {k: v for e in _at_once([lambda s=s: edges(*s) for s in sets], len(sets)) for k, v in e.items()})
    depths, rounds = sorted(grid["maxDepth"], reverse=True), max(grid["maxIter"])

    def boosted(jobs):
        """Errors of jobs (edges' set, bins, depth, training parts, scored parts)."""
        return cl.boosted_jobs(spark, known, [((name, b), b, min(d, C.SPARK_MAX_TREE_DEPTH), at, scored)
                                              for name, b, d, at, scored in jobs], rounds, C.GBT_STEP, C.LEAST_INFO_GAIN)

    def fit(kept, bins, depth, n):
        return GBTRegressor(labelCol="y", featuresCol="features", maxDepth=min(depth, C.SPARK_MAX_TREE_DEPTH),
                            maxBins=bins, maxIter=n, stepSize=C.GBT_STEP, seed=seed, maxMemoryInMB=C.TREE_MEMORY_MB,
                            minInfoGain=C.LEAST_INFO_GAIN).fit(assemble(kept, columns))

    def fold_errors(bins, depth, fold):
        return staged_errors(fit(train.where(F.col("part") != fold), bins, depth, rounds),
                             assemble(train.where(F.col("part") == fold), columns))

    jobs = [(b, d, f) for d in depths for b in grid["maxBins"] for f in range(folds)]
    if known:
        errors = boosted([(f, b, d, others[f], [f]) for b, d, f in jobs])
    else:
        errors = _at_once([lambda j=j: fold_errors(*j) for j in jobs], parallelism)
    mse = [{} for _ in range(folds)]
    for (b, d, f), found in zip(jobs, errors):
        mse[f] |= {(b, d, i): found[i - 1] for i in grid["maxIter"]}

    def holdout(best):
        bins, depth, n = best
        if known:
            at = boosted([("all", bins, depth, [*range(folds)], [-1])])[0][n - 1]
            return None if math.isnan(at) else math.sqrt(at)
        scored = fit(train, bins, depth, n).transform(assemble(data.where(F.col("part") == -1), columns))
        return scored.agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)).alias("r")).first()["r"]

    maps = [(b, d, i) for d in grid["maxDepth"] for b in grid["maxBins"] for i in grid["maxIter"]]
    out = _grid_rows(df.sparkSession, ["maxBins", "requested", "maxIter"], maps, mse, holdout, [m[1] for m in maps])
    return out.withColumn("maxDepth", F.least("requested", F.lit(float(C.SPARK_MAX_TREE_DEPTH)))).select(
        "maxBins", "maxDepth", "maxIter", "avg_rmse", "holdout_rmse", "best", "requested_maxDepth")


def gbt_early_stop(train: DataFrame, valid: DataFrame, features: list[str], label: str,
                   max_iter: int = 100, tol: float = 0.001, step_size: float = 0.3,
                   seed: int = C.RF_SEED, layout_keys: list[str] | None = None) -> tuple:
    """GBT with a validation indicator: boosting stops once the
    validation error improves by less than ``tol`` (relative).  Spark fits
    the first tree at full weight, so a small step needs a small tolerance
    to let later trees count.  Returns (model, data)."""
    data = (train.withColumn("_is_valid", F.lit(False))
            .unionByName(valid.withColumn("_is_valid", F.lit(True))))
    data = assemble(data, features)
    if layout_keys:
        data = stable_layout(data, layout_keys)
    gbt = GBTRegressor(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=3,
                       stepSize=step_size, validationIndicatorCol="_is_valid",
                       validationTol=tol, seed=seed)
    return gbt.fit(data), data


def first_iterations(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The boosted model of the first ``n`` iterations of ``model``, without a fit."""
    sc, java = SparkContext._active_spark_context, model._java_obj
    kind = sc._jvm.org.apache.spark.ml.regression
    trees = sc._gateway.new_array(kind.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for i, (tree, weight) in enumerate(zip(java.trees()[:n], model.treeWeights)):
        trees[i], weights[i] = tree, weight
    cut = model._copyValues(GBTRegressionModel(kind.GBTRegressionModel(java.uid(), trees, weights)))
    return cut._set(maxIter=n)


def gbt_keep_best(train: DataFrame, valid: DataFrame, features: list[str], label: str, max_iter: int = 100,
                  patience: int = C.PATIENCE, step_size: float = 0.3, max_depth: int = 3, seed: int = C.RF_SEED,
                  layout_keys: list[str] | None = None) -> tuple:
    """M14, keep the best: (model, curve).  ``curve`` has the validation RMSE
    after each iteration until ``patience`` iterations brought nothing better;
    the model is the sequence cut at its best iteration (the first of equals).

    Boosting does not look ahead, so the shorter sequence is the longer one's
    beginning: curve and model come from one long fit and one pass over
    ``valid``."""
    prepare = lambda df: assemble(df, features)
    rows = stable_layout(prepare(train), layout_keys) if layout_keys else prepare(train)
    rows = rows.select("features", label).checkpoint(eager=True)
    whole = GBTRegressor(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=max_depth,
                         stepSize=step_size, seed=seed).fit(rows)
    curve, best = [], 0
    for i, mse in enumerate(staged_errors(whole, prepare(valid))):
        curve.append(math.sqrt(mse))
        if curve[i] < curve[best]:
            best = i
        if i - best >= patience:
            break
    return (whole if best + 1 == max_iter else first_iterations(whole, best + 1)), curve


# ------------------------------------------------------------ SMAPE tooling
class SmapeEvaluator(Evaluator):
    """Mean SMAPE of (label, prediction) as a Spark ML evaluator (smaller is
    better); usable in CrossValidator / TrainValidationSplit."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.labelCol = labelCol
        self.predictionCol = predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        row = dataset.select(F.avg(smape_term(self.labelCol, self.predictionCol)).alias("s")).first()
        return float(row["s"]) if row and row["s"] is not None else float("nan")

    def isLargerBetter(self) -> bool:
        return False


def sample_param_maps(estimator, space: dict, n_trials: int = C.SEARCH_TRIALS,
                      seed: int = C.GLOBAL_SEED) -> list[dict]:
    """Seeded random search.  ``space`` maps a param name to a list of
    choices or to ``("log", lo, hi)`` / ``("uniform", lo, hi)``.  Distinct
    maps only; at most ``n_trials``."""
    return [{estimator.getParam(k): v for k, v in pm.items()}
            for pm in sample_settings(space, n_trials, seed)]


def sample_settings(space: dict, n_trials: int = C.SEARCH_TRIALS,
                    seed: int = C.GLOBAL_SEED) -> list[dict]:
    """Seeded random draws of plain settings (same spec as
    ``sample_param_maps``), distinct, at most ``n_trials``."""
    rng = np.random.default_rng(seed)
    out, seen = [], set()
    for _ in range(n_trials * 20):
        if len(out) >= n_trials:
            break
        draw = {}
        for name, spec in space.items():
            if isinstance(spec, tuple) and spec and spec[0] in ("log", "uniform"):
                kind, lo, hi = spec
                v = math.exp(rng.uniform(math.log(lo), math.log(hi))) if kind == "log" \
                    else rng.uniform(lo, hi)
                v = float(f"{v:.6g}")
            else:
                v = spec[int(rng.integers(len(spec)))]
                v = v.item() if hasattr(v, "item") else v
            draw[name] = v
        sig = tuple(sorted(draw.items()))
        if sig not in seen:
            seen.add(sig)
            out.append(draw)
    return out


def _stage_settings(stages) -> tuple:
    """What tells feature stages apart: their kinds and parameter values
    (without the stage's own id, which unset output columns are named by)."""
    return tuple((type(s).__name__, tuple(sorted((p.name, str(v).replace(s.uid, ""))
                                                 for p, v in s.extractParamMap().items()))) for s in stages)


def random_search_pipelines(train: DataFrame, valid: DataFrame, build, space: dict,
                            n_trials: int = C.SEARCH_TRIALS, label: str = "target",
                            seed: int = C.GLOBAL_SEED, parallelism: int = 4) -> DataFrame:
    """M11 with structure in the space: ``build(settings) -> Pipeline`` makes
    one pipeline per sampled setting (e.g. with or without the series
    encoding), each fit on ``train`` and scored by SMAPE on the time-ordered
    ``valid`` rows.  Every fit is distributed; a few run at a time.

    Trials whose stages before the last are equal share them: those are fitted
    once, and their output is stored by column (only what the last stage and
    the score read), as a fit reads its input several times."""
    ev = SmapeEvaluator(labelCol=label)
    settings = sample_settings(space, n_trials, seed)
    stages = [build(s).getStages() for s in settings]
    groups = {}
    for *first, last in stages:
        read = {last.getOrDefault(p) for p in last.params if p.name.endswith("Col") and last.isDefined(p)}
        groups.setdefault(_stage_settings(first), (first, {label}))[1].update(read)

    def prepared(key):
        first, read = groups[key]
        model = Pipeline(stages=first).fit(train)
        parts = []
        for rows in (train, valid):
            out = model.transform(rows)
            out = out.select(*[c for c in out.columns if c in read])
            parts.append(columnar(out, scratch_path(train.sparkSession, "search-features")))
        return key, parts

    tables = dict(_at_once([lambda k=k: prepared(k) for k in groups], parallelism))

    def trial(i, setting, first, last):
        fit_on, score_on = tables[_stage_settings(first)]
        desc = ", ".join(f"{k}={setting[k]}" for k in sorted(setting))
        return i, desc, ev.evaluate(last.fit(fit_on).transform(score_on))

    rows = _at_once([lambda i=i, s=s, st=st: trial(i, s, st[:-1], st[-1])
                     for i, (s, st) in enumerate(zip(settings, stages))], parallelism)
    out = train.sparkSession.createDataFrame(rows, "trial int, params string, smape double")
    rk = F.row_number().over(Window.orderBy("smape", "trial"))
    return out.select("trial", "params", "smape", rk.cast("int").alias("rank"))


def random_search(train: DataFrame, valid: DataFrame, estimator, space: dict, n_trials: int,
                  label: str, seed: int = C.GLOBAL_SEED) -> DataFrame:
    """Fit each sampled parameter map on ``train`` and score SMAPE on the
    time-ordered ``valid`` rows.  ``fitMultiple`` shares the cached input."""
    maps = sample_param_maps(estimator, space, n_trials, seed)
    ev = SmapeEvaluator(labelCol=label)
    rows = []
    for idx, model in estimator.fitMultiple(train, maps):
        pm = maps[idx]
        desc = ", ".join(f"{p.name}={pm[p]}" for p in sorted(pm, key=lambda p: p.name))
        rows.append((idx, desc, ev.evaluate(model.transform(valid))))
    out = train.sparkSession.createDataFrame(rows, "trial int, params string, smape double")
    rk = F.row_number().over(Window.orderBy("smape", "trial"))
    return out.select("trial", "params", "smape", rk.cast("int").alias("rank"))


# ----------------------------------------------- pooled autoregression
def lag_features(length: int = C.SEQUENCE_LENGTH) -> list[str]:
    return [f"x_{i}" for i in range(1, length + 1)]


def flatten_windows(windows: DataFrame, length: int = C.SEQUENCE_LENGTH) -> DataFrame:
    """Sequence windows with the array ``x`` spread into ``x_1..x_L``."""
    return windows.select("*", *[F.element_at("x", i).alias(f"x_{i}") for i in range(1, length + 1)])


def series_encoding(train: DataFrame, key: str = "series", label: str = "target",
                    smoothing: float = 1.0, out: str = "series_te") -> DataFrame:
    """One row per series of ``train`` with its smoothed mean target,
    ``(sum + smoothing * overall mean) / (rows + smoothing)``: the counterpart
    of a learned series embedding.  A grouped aggregate keyed by series; only
    the overall mean reaches the driver."""
    overall = train.agg(F.avg(label).alias("m")).first()["m"]
    return train.groupBy(key).agg(
        ((F.coalesce(F.sum(label), F.lit(0.0)) + F.lit(smoothing) * F.lit(overall))
         / (F.count(label) + F.lit(smoothing))).alias(out))


def add_series_encoding(df: DataFrame, train: DataFrame, key: str = "series", label: str = "target",
                        smoothing: float = 1.0, out: str = "series_te") -> DataFrame:
    """``df`` with the encoding learned from ``train``; a series that ``train``
    lacks (or a NULL key) gets the overall mean."""
    overall = train.agg(F.avg(label).alias("m")).first()["m"]
    enc = series_encoding(train.where(F.col(key).isNotNull()), key, label, smoothing, out)
    return df.join(enc, key, "left").withColumn(out, F.coalesce(out, F.lit(overall).cast("double")))


def series_factors(train: DataFrame, rank: int, key: str = "series", t: str = "t", label: str = "target",
                   reg: float = 0.1, rounds: int = 10, seed: int = C.GLOBAL_SEED) -> DataFrame:
    """One row per series of ``train`` with ``rank`` numbers (array
    ``factors``): the series side of a factorisation of the series x period
    matrix of targets by alternating least squares, the counterpart of a
    learned id embedding.  Only cells of ``train`` are seen.  Ids are dense
    numbers from a distributed rank, so the key may have any type; cells with
    a NULL key or target are left out."""
    from .joins import dense_ids
    cells = train.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, t, label)
    rows, periods = dense_ids(cells, key, "_row"), dense_ids(cells, t, "_period")
    numbered = (cells.join(rows, key).join(F.broadcast(periods), t)       # the periods of a calendar
                .select(F.col("_row").cast("int"), F.col("_period").cast("int"), F.col(label).cast("float").alias("_v")))
    model = ALS(rank=rank, maxIter=rounds, regParam=reg, userCol="_row", itemCol="_period", ratingCol="_v", seed=seed,
                checkpointInterval=10).fit(numbered)
    found = model.userFactors.select(F.col("id").alias("_row"), F.col("features").cast("array<double>").alias("factors"))
    return rows.withColumn("_row", F.col("_row").cast("int")).join(found, "_row").select(key, "factors")


def add_series_factors(df: DataFrame, factors: DataFrame, rank: int, key: str = "series",
                       out: str = "series_factors") -> DataFrame:
    """``df`` with the vector ``out`` of its series' factors; zeros for a series
    that the factorisation has not seen (or a NULL key)."""
    zeros = F.array_repeat(F.lit(0.0), rank)
    return (df.join(factors.withColumnRenamed("factors", out), key, "left")
            .withColumn(out, array_to_vector(F.coalesce(out, zeros))))


def pooled_ar_pipeline(kind: str = "gbt", length: int = C.SEQUENCE_LENGTH, seed: int = C.RF_SEED,
                       group_col: str | None = "state", series_col: str | None = None,
                       reg_param: float = 1e-4, epsilon: float = 1.35) -> Pipeline:
    """One model for all series.  Inputs: the last ``length``
    values, a one-hot group (few values: its labels reach the driver) and,
    with ``series_col``, that column of encoded series ids (a number, see
    ``add_series_encoding``, or a vector, see ``add_series_factors``); target: the next value.  ``kind``: 'gbt', 'rf',
    'linear' or 'huber' (Huber loss, L2)."""
    stages, inputs = [], lag_features(length)
    if group_col:
        stages += [StringIndexer(inputCol=group_col, outputCol="_g_idx", handleInvalid="keep",
                                 stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=["_g_idx"], outputCols=["_g_vec"], handleInvalid="keep")]
        inputs.append("_g_vec")
    if series_col:
        inputs.append(series_col)
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    if kind == "gbt":
        reg = GBTRegressor(labelCol="target", featuresCol="features", maxIter=30, maxDepth=4,
                           seed=seed)
    elif kind == "rf":
        reg = RandomForestRegressor(labelCol="target", featuresCol="features", numTrees=40,
                                    maxDepth=6, seed=seed)
    elif kind == "linear":
        reg = LinearRegression(labelCol="target", featuresCol="features", regParam=0.0)
    elif kind == "huber":
        reg = LinearRegression(labelCol="target", featuresCol="features", loss="huber",
                               regParam=reg_param, epsilon=epsilon, elasticNetParam=0.0)
    else:
        raise ValueError(kind)
    return Pipeline(stages=stages + [reg])


def recursive_forecast(model: PipelineModel, state: DataFrame, horizons: DataFrame,
                       steps: int = C.VALIDATION_LENGTH, length: int = C.SEQUENCE_LENGTH,
                       model_name: str = "pooled",
                       checkpoint_every: int = 10) -> DataFrame:
    """Multi-step forecast by feeding predictions back.

    ``state``: one row per series with ``series, state, x`` (the last
    ``length`` known values, oldest first) and any id columns the model
    reads (carried along unchanged).  ``horizons``: (t, h) of the
    held-out periods.  Each step scores all series at once with
    ``model.transform``, shifts the prediction into ``x`` and appends it to
    ``preds``; the predictions are exploded once at the end, so each step is
    computed once.  The plan is checkpointed every ``checkpoint_every`` steps
    to bound its depth.

    A series whose ``x`` is NULL, holds a NULL or has fewer than ``length``
    values cannot be forecast: its rows come with a NULL ``p``.  ``horizons``
    is broadcast: ``steps`` rows."""
    keep = [c for c in state.columns if c not in ("x",)]
    ready = F.coalesce((F.size("x") == length) & ~F.exists("x", lambda v: v.isNull()), F.lit(False))
    short = (state.where(~ready).select("series", "state", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("h"))
             .withColumn("p", F.lit(None).cast("double")))
    cur = state.where(ready).select(*keep, "x", F.array().cast("array<double>").alias("preds"))
    for h in range(1, steps + 1):
        scored = model.transform(flatten_windows(cur, length))
        cur = scored.select(
            *keep,
            F.slice(F.concat("x", F.array("prediction")), 2, length).alias("x"),
            F.concat("preds", F.array("prediction")).alias("preds"))
        if checkpoint_every and h % checkpoint_every == 0 and h < steps:
            cur = cur.checkpoint(eager=True)
    long = cur.select("series", "state", F.posexplode("preds").alias("_i", "p"))
    long = long.select("series", "state", (F.col("_i") + 1).cast("int").alias("h"), "p")
    return (long.unionByName(short)
            .join(F.broadcast(horizons), "h")
            .select(F.lit(model_name).alias("model"), "series", "state", "t", "h", "p"))


def huber_coefficients(model: PipelineModel,
                       length: int = C.SEQUENCE_LENGTH) -> list[tuple[str, float]]:
    reg = model.stages[-1]
    names = lag_features(length)
    coefs = reg.coefficients.toArray().tolist()
    out = [(names[i] if i < len(names) else f"group_{i - len(names)}", float(c))
           for i, c in enumerate(coefs)]
    return out + [("intercept", float(reg.intercept))]
