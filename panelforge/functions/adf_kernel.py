"""Augmented Dickey-Fuller test kernel (numpy only), run per series inside
``applyInPandas``.

The module is registered with cloudpickle to be serialized by value, so the
Python workers need neither this package installed nor the driver's
``sys.path``: the functions travel with the task.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import types as T

# ---------------------------------------------------------------- ADF
# MacKinnon (1994) p-value surface and MacKinnon (2010)
# critical-value polynomials for the constant-only regression, one series.
ADF_TAU_MAX = 2.74
ADF_TAU_MIN = -18.83
ADF_TAU_STAR = -1.61
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRIT = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809),
}

ADF_SCHEMA = T.StructType([
    T.StructField("series", T.IntegerType()), T.StructField("adf_stat", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()), T.StructField("used_lag", T.IntegerType()),
    T.StructField("n_obs", T.IntegerType()), T.StructField("crit_1", T.DoubleType()),
    T.StructField("crit_5", T.DoubleType()), T.StructField("crit_10", T.DoubleType()),
    T.StructField("ic_best", T.DoubleType())])


def _norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def adf_pvalue(tau: float) -> float:
    """Approximate p-value of the ADF statistic (constant, no trend)."""
    if tau > ADF_TAU_MAX:
        return 1.0
    if tau < ADF_TAU_MIN:
        return 0.0
    coef = ADF_SMALL_P if tau <= ADF_TAU_STAR else ADF_LARGE_P
    return _norm_cdf(sum(c * tau ** i for i, c in enumerate(coef)))


def adf_critical(nobs: int) -> dict[str, float]:
    return {name: sum(b / nobs ** i for i, b in enumerate(poly)) for name, poly in ADF_CRIT.items()}


def _ols(yv: np.ndarray, X: np.ndarray):
    beta, *_ = np.linalg.lstsq(X, yv, rcond=None)
    resid = yv - X @ beta
    return beta, float(resid @ resid)


def _design(x: np.ndarray, dx: np.ndarray, lags: int, nobs: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the regression dy_t ~ [y_{t-1}, dy_{t-1..t-lags}] on the last
    ``nobs`` differences."""
    m = len(dx)
    cols = [x[m - nobs:m]]                     # level y_{t-1}
    for j in range(1, lags + 1):
        cols.append(dx[m - nobs - j:m - j])    # lagged differences
    return dx[m - nobs:], np.column_stack(cols)


def adf_test(values: np.ndarray, maxlag: int | None = None) -> dict | None:
    """Augmented Dickey-Fuller test with a constant, lag chosen by AIC.

    Returns None for series that are too short (< 12 points), constant, or
    contain NULLs."""
    x = np.asarray(values, dtype=float)
    n = len(x)
    if n < 12 or not np.all(np.isfinite(x)) or np.ptp(x) == 0:
        return None
    if maxlag is None:
        maxlag = int(math.ceil(12.0 * (n / 100.0) ** 0.25))
        maxlag = min(n // 2 - 2, maxlag)
    if maxlag < 0:
        return None
    dx = np.diff(x)
    nobs = len(dx) - maxlag
    best = None
    for lags in range(0, maxlag + 1):
        yv, X = _design(x, dx, lags, nobs)
        X = np.column_stack([np.ones(nobs), X])
        _, ssr = _ols(yv, X)
        if ssr <= 0:
            continue
        k = X.shape[1]
        llf = -nobs / 2.0 * (math.log(2 * math.pi) + math.log(ssr / nobs) + 1.0)
        aic = -2.0 * llf + 2.0 * k
        if best is None or aic < best[0]:
            best = (aic, lags)
    if best is None:
        return None
    icbest, used = best
    nobs = len(dx) - used
    yv, X = _design(x, dx, used, nobs)
    X = np.column_stack([X, np.ones(nobs)])
    beta, ssr = _ols(yv, X)
    dof = nobs - X.shape[1]
    if dof <= 0 or ssr <= 0:
        return None
    sigma2 = ssr / dof
    cov = sigma2 * np.linalg.inv(X.T @ X)
    tau = float(beta[0] / math.sqrt(cov[0, 0]))
    crit = adf_critical(nobs)
    return {"adf_stat": tau, "p_value": adf_pvalue(tau), "used_lag": used, "n_obs": nobs,
            **crit, "ic_best": icbest}


def adf_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("t")
    res = adf_test(pdf["y"].to_numpy(dtype=float))
    row = {"series": pdf["series"].iloc[0]}
    for f in ADF_SCHEMA.fieldNames()[1:]:
        row[f] = None if res is None else res[f]
    return pd.DataFrame([row])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
