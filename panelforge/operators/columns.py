"""Column-level operators: projection, casts, NULL handling, date parts
(inventory P1-P12, F1-F2, F5).

Every helper emits one projection (``select``/``withColumns``/``drop`` with
all names at once) instead of a loop of ``withColumn`` calls, so the logical
plan stays one node deep however many columns are touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.exprs import month_index


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop several columns; names that do not exist are ignored."""
    return df.drop(*names)


def cast_columns(df: DataFrame, names: list[str], types: list[str], strict: bool = False) -> DataFrame:
    """P5: cast ``names[i]`` to ``types[i]`` (pairs beyond the shorter list are
    ignored, like ``zip``).  Malformed values become NULL (``try_cast``);
    ``strict=True`` uses ``cast`` and fails on them under ANSI mode."""
    pairs = dict(zip(names, types))
    return df.withColumns({
        n: (F.col(n).cast(t) if strict else F.col(n).try_cast(t)) for n, t in pairs.items()})


def complete_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any (or any listed) column.  Call it after
    the casts so that cast-made NULLs are dropped too."""
    return df.na.drop("any", subset=subset)


def date_parts(df: DataFrame, text_col: str, fmt: str = "yyyy-MM-dd", out: str = "date") -> DataFrame:
    """Parse a date string (malformed → NULL) and add year, month
    and day columns."""
    d = F.try_to_date(F.col(text_col), fmt)
    return df.withColumns({out: d, "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d)})


def add_month_index(df: DataFrame, t: str = "t", out: str = "x",
                    year0: int = C.MONTH_INDEX_ORIGIN[0],
                    month0: int = C.MONTH_INDEX_ORIGIN[1]) -> DataFrame:
    """whole months since (year0, month0)."""
    return df.withColumn(out, month_index(t, year0, month0))


def feature_columns(df: DataFrame, exclude: list[str]) -> list[str]:
    """The numeric columns of ``df`` that are not excluded (the label
    must be in ``exclude``; it is never a feature)."""
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    return [n for n, t in df.dtypes if n not in set(exclude) and t in numeric]
