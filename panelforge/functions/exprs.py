"""Column expressions shared by the operators.

All of them are built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none needs a Python worker.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pairwise_corr(x: ColumnOrName, y: ColumnOrName) -> Column:
    """Pearson correlation as an aggregate over rows where both inputs are
    non-null.

    ``F.corr`` raises DIVIDE_BY_ZERO under ANSI mode for a constant group, so
    the ratio is formed with ``try_divide``: a constant or single-row group
    gives NULL (never NaN, because NaN > 0 is true in Spark).
    """
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    xs = F.when(both, x.cast("double"))
    ys = F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def sign_colour(r: ColumnOrName) -> Column:
    """'green' for a positive value, 'red' otherwise (NULL included)."""
    return F.when(_col(r) > 0, F.lit("green")).otherwise(F.lit("red"))


def days_from(t: ColumnOrName, anchor: _dt.date) -> Column:
    """Signed days between a date column and a fixed anchor date.

    The reference anchors at today's date; a correlation is invariant to the
    shift, so the anchor is a parameter and results are reproducible."""
    return F.datediff(_col(t), F.lit(anchor))


def series_label(county: ColumnOrName, state: ColumnOrName) -> Column:
    """``county + ", " + state``; NULL when either part is NULL."""
    return F.concat(_col(county), F.lit(", "), _col(state))


def month_index(t: ColumnOrName, year0: int = C.MONTH_INDEX_ORIGIN[0],
                month0: int = C.MONTH_INDEX_ORIGIN[1]) -> Column:
    """Whole months since (year0, month0); 0 at that month."""
    t = _col(t)
    return (F.year(t) - F.lit(year0)) * 12 + F.month(t) - F.lit(month0)


def smape_term(y: ColumnOrName, p: ColumnOrName, strict: bool = False) -> Column:
    """Per-row symmetric absolute percentage error in [0, 200].

    Same formula as the reference: denominator ``(y + |p|) / 200`` with the
    row scored 0 when the denominator is 0.  ``strict=True`` uses ``|y|`` in
    the denominator, which keeps the range for negative targets."""
    y, p = _col(y).cast("double"), _col(p).cast("double")
    # 200 * |y - p| / (y + |p|): the same value as dividing by (y + |p|) / 200,
    # but it stays within [0, 200] in floating point for tiny (subnormal)
    # inputs, where scaling the denominator first loses precision.
    total = (F.abs(y) if strict else y) + F.abs(p)
    return F.when(total == 0, F.lit(0.0)).otherwise(
        F.lit(C.SMAPE_SCALE) * F.abs(y - p) / total)


def hash_percent(key: ColumnOrName) -> Column:
    """Deterministic bucket 0..99 from the MD5 of the key's text form.

    Unlike ``randomSplit`` it does not depend on partitioning or row order,
    and DuckDB computes the same value (``md5`` + hex parsing)."""
    h = F.conv(F.substring(F.md5(_col(key).cast("string")), 1, 8), 16, 10)
    return (h.cast("bigint") % 100).cast("int")
