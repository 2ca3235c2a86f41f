"""Helpers shared by the tests."""

import datetime as dt


def make_panel(spark, rows, schema="series int, t date, density double"):
    """Small long-format panel from python rows, hash-partitioned by series."""
    return spark.createDataFrame(rows, schema)


def months(n, start=(2000, 1)):
    y, m = start
    out = []
    for _ in range(n):
        out.append(dt.date(y, m, 1))
        m += 1
        if m == 13:
            y, m = y + 1, 1
    return out
