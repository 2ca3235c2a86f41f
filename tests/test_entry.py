import math
import os

import duckdb
import pytest

from conftest import SF_ORACLE, SF_SMOKE

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["correlation", "state", "color"]


def test_every_oracle_has_a_query():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 50


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _with_oracle():
    from panelforge.plans.catalog import ORACLE
    return sorted(ORACLE)


@pytest.mark.parametrize("name", _with_oracle())
def test_oracle_matches_small(spark, name):
    import __spark_entry__ as e
    sf = SF_ORACLE if os.path.exists(SF_ORACLE) else SF_SMOKE
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sdf = e.queries()[name](spark, sf)
    rel = con.sql(e.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sdf.columns]
    a = sorted((tuple(_norm(v) for v in r) for r in sdf.collect()), key=str)
    b = sorted((tuple(_norm(r[i]) for i in order) for r in rel.fetchall()), key=str)
    assert a == b
