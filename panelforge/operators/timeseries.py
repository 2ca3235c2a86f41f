"""Per-series statistics: seasonal decomposition, ACF, PACF, ADF.

The reference ran these on one pandas series at a time.  Here each takes a
long ``(series, t, y)`` DataFrame and answers for all series in one job:

* decomposition, ACF and PACF are pure window/aggregate/higher-order-function
  plans on the panel's series partitioning (no shuffle, no Python);
* ADF (OLS with a lag search) is a fold over one array per series of at most
  #calendar-months values; ``functions/adf_kernel.py`` is the same test on one
  numpy array, for single series and as a check.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.adf_kernel import (ADF_CRIT, ADF_LARGE_P, ADF_SMALL_P, ADF_TAU_MAX,  # noqa: F401
                                    ADF_TAU_MIN, ADF_TAU_STAR, adf_critical, adf_pvalue, adf_test)
from .windows import centred_ma, series_window


def decompose(df: DataFrame, y: str = "density", period: int = C.SEASONAL_PERIOD,
              key: str = "series",
              order: str = "t") -> DataFrame:
    """T5: additive decomposition ``y = trend + seasonal + resid``.

    trend: centred 2 x ``period`` moving average (NULL on the first and last
    period/2 rows); seasonal: mean detrended value per phase (row position
    mod period from the series start), centred over the phases; resid: the
    rest.  Series shorter than two periods get NULL components."""
    w = series_window(key, order)
    step1 = df.select(
        key, order, F.col(y).alias("y"),
        centred_ma(y, period, key, order).alias("trend"),
        ((F.row_number().over(w) - 1) % period).alias("phase"),
        F.count(F.lit(1)).over(Window.partitionBy(key)).alias("_n"))
    pw = Window.partitionBy(key, "phase")
    step2 = step1.select(
        "*", F.avg(F.col("y") - F.col("trend")).over(pw).alias("_pavg"),
        (F.row_number().over(pw.orderBy(order)) == 1).alias("_first"))
    step3 = step2.withColumn(
        "_centre", F.avg(F.when(F.col("_first"), F.col("_pavg"))).over(Window.partitionBy(key)))
    ok = F.col("_n") >= 2 * period
    seasonal = F.col("_pavg") - F.col("_centre")
    return step3.select(
        key, order, "y",
        F.when(ok, F.col("trend")).alias("trend"),
        F.when(ok, seasonal).alias("seasonal"),
        F.when(ok, F.col("y") - F.col("trend") - seasonal).alias("resid"))


def acf_arrays(df: DataFrame, y: str = "density", key: str = "series",
               order: str = "t") -> DataFrame:
    """Per series: ``n``, the lag count ``K = min(ceil(10 log10 n), n // 2)``,
    ``r`` = [r_1 .. r_K] (biased autocovariance ratio) and its values ``y``.

    Each series is gathered once into an ordered array (bounded by the length
    of the calendar); the lags are higher-order functions over it, so their
    number follows the length of the series.  A NULL keeps its position and
    adds nothing to any product."""
    rows = df.groupBy(key).agg(
        F.count(y).alias("n"), F.avg(y).alias("_m"),
        F.sort_array(F.collect_list(F.struct(F.col(order), F.col(y).cast("double").alias("_y")))).alias("_s"))
    c = F.transform("_s", lambda s: F.coalesce(s["_y"] - F.col("_m"), F.lit(0.0)))
    kmax = F.least(F.ceil(F.lit(10.0) * F.log10("n")).cast("int"), (F.col("n") / 2).cast("int"))
    lags = F.when(kmax >= 1, F.sequence(F.lit(1), kmax)).otherwise(F.array().cast("array<int>"))

    def product(c, k):
        later = F.slice(c, k + 1, F.size(c))
        # the shorter side ends the zip with NULLs, which are skipped
        return F.aggregate(F.zip_with(later, c, lambda p, q: F.coalesce(p * q, F.lit(0.0))),
                           F.lit(0.0), lambda total, x: total + x)

    r = once(c, lambda c: once(product(c, F.lit(0)), lambda s0: F.transform(
        lags, lambda k: F.try_divide(product(c, k), s0))))
    return rows.select(key, "n", kmax.alias("K"), r.alias("r"), F.transform("_s", lambda s: s["_y"]).alias("y"))


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated a single time, however often
    the body names it (expressions inside a lambda are not shared)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def acf(df: DataFrame, y: str = "density", key: str = "series",
        order: str = "t") -> DataFrame:
    """Autocorrelation per series for k = 1..K with the 95 % Bartlett
    band ``1.96 * sqrt((1 + 2 * sum_{i<k} r_i^2) / n)``; one row per
    (series, k)."""
    a = acf_arrays(df, y, key, order)
    long = (a.select(key, "n", "K", F.posexplode("r").alias("_i", "acf"))
            .where(F.col("_i") < F.col("K"))
            .select(key, "n", (F.col("_i") + 1).cast("int").alias("k"), "acf"))
    prior = F.sum(F.col("acf") * F.col("acf")).over(
        Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    band = F.lit(1.96) * F.sqrt((F.lit(1.0) + F.lit(2.0) * F.coalesce(prior, F.lit(0.0))) / F.col("n"))
    return long.select(key, "k", "acf", band.alias("band"), "n")


def durbin_levinson(r: Column, kp: Column) -> Column:
    """Partial autocorrelations phi_kk, k = 1..kp, from the autocorrelation
    array ``r`` (r_1 first), as a Spark higher-order-function expression.

    The fold keeps (phi_{k-1}, v_{k-1}, out); each step computes
    phi_kk = (r_k - sum_j phi_{k-1,j} r_{k-j}) / v_{k-1}, updates
    phi_{k,j} = phi_{k-1,j} - phi_kk phi_{k-1,k-j} and v_k = v_{k-1}(1 - phi_kk^2)."""
    def step(acc, k):
        dot = F.aggregate(F.zip_with(acc["phi"], F.reverse(F.slice(acc["r"], F.lit(1), k - 1)),
                                     lambda x, z: x * z), F.lit(0.0), lambda s, z: s + z)

        def update(a):
            phi = F.concat(F.zip_with(acc["phi"], F.reverse(acc["phi"]), lambda p, q: p - a * q),
                           F.array(a))
            return F.struct(acc["r"].alias("r"), phi.alias("phi"),
                            (acc["v"] * (F.lit(1.0) - a * a)).alias("v"),
                            F.concat(acc["out"], F.array(a)).alias("out"))
        return once(F.try_divide(F.element_at(acc["r"], k) - dot, acc["v"]), update)

    # r travels in the state, so the fold evaluates it once
    empty = F.array().cast("array<double>")
    init = F.struct(r.alias("r"), empty.alias("phi"), F.lit(1.0).alias("v"), empty.alias("out"))
    ks = F.when(kp >= 1, F.sequence(F.lit(1), kp)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ks, init, step)["out"]


def pacf(df: DataFrame, y: str = "density", key: str = "series",
         order: str = "t") -> DataFrame:
    """T4: partial autocorrelation (Yule-Walker with the biased
    autocovariance, solved by Durbin-Levinson on the ACF array) for
    k <= min(K, n // 2 - 1), band ``1.96 / sqrt(n)``.  Runs entirely in
    JVM expressions on one short array per series."""
    a = acf_arrays(df, y, key, order)
    kp = F.least(F.col("K"), (F.col("n") / 2).cast("int") - 1)
    out = a.select(key, "n", durbin_levinson(F.col("r"), kp).alias("_p"))
    return (out.select(key, "n", F.posexplode("_p").alias("_i", "pacf"))
            .select(key, (F.col("_i") + 1).cast("int").alias("k"),
                    "pacf", (F.lit(1.96) / F.sqrt(F.col("n"))).alias("band"), "n"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _centred(c: Column) -> Column:
    """The array less its mean: a regression on centred columns is the one
    with a constant."""
    return once(c, lambda v: once(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v),
                                  lambda m: F.transform(v, lambda x: x - m)))


def _regressions(y: Column, columns: Column) -> Column:
    """Least squares of ``y`` on the first 1, 2, .. of the columns, by adding
    one orthonormal column at a time (modified Gram-Schmidt).  Struct of the
    squared residuals ``ssr`` after each, and of the last column's coordinate
    ``z``.  A column that the earlier ones span adds nothing."""
    def step(state, c):
        rest = F.aggregate(state["q"], c, lambda v, q: once(_dot(v, q), lambda d: F.zip_with(v, q, lambda x, e: x - d * e)))

        def add(r):
            size = F.sqrt(_dot(r, r))
            unit = once(F.when(size > 1e-9 * F.sqrt(_dot(c, c)), 1.0 / size).otherwise(0.0),
                        lambda f: F.transform(r, lambda x: x * f))
            return once(unit, lambda q: once(_dot(q, state["y"]), lambda z: once(
                F.zip_with(state["y"], q, lambda x, e: x - z * e), lambda left: F.struct(
                    F.concat(state["q"], F.array(q)).alias("q"), left.alias("y"), z.alias("z"),
                    F.concat(state["ssr"], F.array(_dot(left, left))).alias("ssr")))))
        return once(rest, add)

    none = F.array().cast("array<double>")
    start = F.struct(F.array().cast("array<array<double>>").alias("q"), y.alias("y"), F.lit(0.0).alias("z"),
                     none.alias("ssr"))
    return F.aggregate(columns, start, step)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function: 1/2 + density(x) * (x + x^3/3 +
    x^5/(3*5) + ..); beyond 8 it is 0 or 1 to 15 digits."""
    def series(x):
        terms = F.aggregate(F.sequence(F.lit(1), F.lit(150)), F.struct(x.alias("t"), x.alias("s")),
                            lambda a, k: once(a["t"] * x * x / (2 * k + 1), lambda t: F.struct(
                                t.alias("t"), (a["s"] + t).alias("s"))))["s"]
        return F.lit(0.5) + terms * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return once(x, lambda v: F.when(v < -8, 0.0).when(v > 8, 1.0).otherwise(series(v)))


def adf_p_value(tau: Column) -> Column:
    """Approximate p-value of the ADF statistic (constant, no trend)."""
    poly = lambda coef: sum((F.lit(c) * F.pow(tau, F.lit(i)) for i, c in enumerate(coef)), F.lit(0.0))
    return F.when(tau > ADF_TAU_MAX, 1.0).when(tau < ADF_TAU_MIN, 0.0).otherwise(normal_cdf(
        F.when(tau <= ADF_TAU_STAR, poly(ADF_SMALL_P)).otherwise(poly(ADF_LARGE_P))))


def adf(df: DataFrame, y: str = "density", key: str = "series", order: str = "t") -> DataFrame:
    """ADF statistic, p-value, lag used, observations, critical values
    1/5/10 % and best AIC, one row per series, whatever the key's type; rows
    with a NULL key belong to no series.

    Everything is an expression over one ordered array per series (bounded by
    the calendar): the regressions of the lag search, nested on one sample,
    come from one pass that adds a lag at a time, the chosen one is repeated on
    all its observations.  A series of fewer than 12 points, with a NULL or
    non-finite value, or constant, has NULLs."""
    rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("series")).agg(F.transform(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("t"), F.col(y).cast("double").alias("y")))),
        lambda s: s["y"]).alias("x"))
    n = F.size("x")
    finite = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ready = rows.select("series", F.when((n >= 12) & finite & (F.array_max("x") > F.array_min("x")), F.col("x")).alias("x"))
    ready = ready.select(
        "series", "x", F.least(F.ceil(F.lit(12.0) * F.pow(n / 100.0, F.lit(0.25))), F.floor(n / 2) - 2).cast("int").alias("most"),
        F.zip_with(F.slice("x", F.lit(2), n - 1), F.slice("x", F.lit(1), n - 1), lambda a, b: a - b).alias("dx"))
    m = F.size("dx")

    def lags(nobs, k):
        some = F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
                           lambda j: _centred(F.slice("dx", m - nobs - j + 1, nobs)))
        return F.when(k >= 1, some).otherwise(F.array().cast("array<array<double>>"))

    target = lambda nobs: _centred(F.slice("dx", m - nobs + 1, nobs))          # noqa: E731
    level = lambda nobs: F.array(_centred(F.slice("x", m - nobs + 1, nobs)))
    nobs = m - F.col("most")
    searched = ready.withColumn("_f", _regressions(target(nobs), F.concat(level(nobs), lags(nobs, F.col("most")))))
    aic = F.transform("_f.ssr", lambda s, i: F.when(s > 0, F.struct(
        (nobs * (math.log(2 * math.pi) + 1.0 + F.log(s / nobs)) + 2.0 * (i + 2)).alias("ic"), i.alias("lag"))))
    chosen = searched.select("series", "x", "dx", F.array_min(aic).alias("_b")).select(
        "series", "x", "dx", "_b.ic", "_b.lag", (m - F.col("_b.lag")).alias("nobs"))
    final = chosen.withColumn("_f", _regressions(target(F.col("nobs")), F.concat(
        lags(F.col("nobs"), F.col("lag")), level(F.col("nobs")))))
    dof, ssr = F.col("nobs") - F.col("lag") - 2, F.element_at("_f.ssr", -1)
    tau = final.select("series", "ic", "lag", "nobs", F.when((dof > 0) & (ssr > 0), F.col("_f.z") / F.sqrt(ssr / dof)).alias("tau"))
    some = lambda c: F.when(F.col("tau").isNotNull(), c)                       # noqa: E731
    crit = [some(sum((F.lit(b) / F.pow(F.col("nobs"), F.lit(i)) for i, b in enumerate(poly)), F.lit(0.0))).alias(name)
            for name, poly in ADF_CRIT.items()]
    return tau.select("series", F.col("tau").alias("adf_stat"), adf_p_value(F.col("tau")).alias("p_value"),
                      some(F.col("lag")).cast("int").alias("used_lag"), some(F.col("nobs")).cast("int").alias("n_obs"),
                      *crit, some(F.col("ic")).alias("ic_best"))


def ts_summary(df: DataFrame, y: str = "density", key: str = "series",
               order: str = "t") -> DataFrame:
    """The series dashboard as one long table ``(series, stat, k, value)``:
    the series itself (``y``, k = position from 1), ACF and PACF by lag with
    their bands (``acf_band``, ``pacf_band``), and of the ADF test statistic,
    p-value, lag, observations and critical values (k = 0).  One ordered array
    per series, exploded once."""
    a = acf_arrays(df.where(F.col(key).isNotNull()), y, key, order)
    kp = F.least(F.col("K"), (F.col("n") / 2).cast("int") - 1)
    rows = lambda stat, values: F.transform(values, lambda v, i: F.struct(     # noqa: E731
        F.lit(stat).alias("stat"), (i + 1).alias("k"), v.cast("double").alias("value")))
    prior = F.transform(F.slice("r", F.lit(1), F.col("K")), lambda _, i: F.aggregate(
        F.slice("r", F.lit(1), i), F.lit(0.0), lambda s, x: s + x * x))
    partial = durbin_levinson(F.col("r"), kp)
    parts = a.select(F.col(key).alias("series"), "n", "y", F.slice("r", F.lit(1), F.col("K")).alias("acf"),
                     F.transform(prior, lambda p: F.lit(1.96) * F.sqrt((p * 2.0 + 1.0) / F.col("n"))).alias("acf_band"),
                     partial.alias("pacf"))
    parts = parts.select("series", F.explode(F.concat(
        rows("y", F.col("y")), rows("acf", F.col("acf")), rows("acf_band", F.col("acf_band")), rows("pacf", F.col("pacf")),
        rows("pacf_band", F.transform("pacf", lambda _: F.lit(1.96) / F.sqrt(F.col("n")))))).alias("_e"))
    stats = parts.select("series", "_e.stat", F.col("_e.k").cast("int").alias("k"), "_e.value")
    one = lambda stat, c: F.struct(F.lit(stat).alias("stat"), F.col(c).cast("double").alias("value"))
    test = adf(df, y, key, order).select("series", F.explode(F.array(
        one("adf_stat", "adf_stat"), one("adf_p", "p_value"), one("adf_lag", "used_lag"), one("adf_n_obs", "n_obs"),
        *[one(f"adf_{c}", c) for c in ADF_CRIT])).alias("_e"))
    return stats.unionByName(test.select("series", "_e.stat", F.lit(0).alias("k"), "_e.value"))
