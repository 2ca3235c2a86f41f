"""Relational queries: scans, casts, joins, grouped reports (slices 0-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import columns as cols
from ..operators import joins
from ..session import scratch_path
from ..sources.tables import read_table
from ..sources.text import PANEL_SCHEMA, read_csv, write_csv
from . import fixtures as fx
from .catalog import register, rounded

PANEL_COLS = "series, county, state, t, active, round(density, 6) AS density"
ATTR_COLS = ("customers", "avg_acctbal", "share_automobile", "share_building", "share_furniture",
             "share_household", "share_machinery", "suppliers", "supp_bal", "avg_supp_bal", "avg_funded_bal")
ATTR_SQL = ", ".join(
    f"round({c}, 6) AS {c}" if c.startswith(("avg", "share", "supp_bal")) else c for c in ATTR_COLS)


@register("group_time_corr", """
SELECT round(r, 6) AS correlation, state,
       CASE WHEN r > 0 THEN 'green' ELSE 'red' END AS color
FROM (SELECT state,
             CASE WHEN isnan(corr(datediff('day', """ + "DATE '2000-01-01'" + """, t), density))
                  THEN NULL ELSE corr(datediff('day', DATE '2000-01-01', t), density) END AS r
      FROM panel GROUP BY state) g
""")
def q_group_time_corr(spark, sf_dir):
    return rounded(agg.group_time_corr(fx.panel(spark, sf_dir)))


@register("series_time_corr", """
SELECT series, county || ', ' || state AS county_state, state, round(r, 6) AS correlation
FROM (SELECT series, county, state,
             CASE WHEN isnan(corr(datediff('day', DATE '2000-01-01', t), density))
                  THEN NULL ELSE corr(datediff('day', DATE '2000-01-01', t), density) END AS r
      FROM panel GROUP BY series, county, state) g
""")
def q_series_time_corr(spark, sf_dir):
    return rounded(agg.series_time_corr(fx.panel(spark, sf_dir)))


_RANKED_SQL = """
sc AS (
  SELECT series, county || ', ' || state AS county_state,
         CASE WHEN isnan(corr(datediff('day', DATE '2000-01-01', t), density))
              THEN NULL ELSE corr(datediff('day', DATE '2000-01-01', t), density) END AS r
  FROM panel GROUP BY series, county, state
),
rk AS (
  SELECT series, county_state, round(r, 2) AS corr_2dp,
         row_number() OVER (ORDER BY r {dir}, series) AS rank
  FROM sc WHERE r IS NOT NULL
)
SELECT CAST(rk.rank AS INTEGER) AS rank, p.series, rk.county_state, rk.corr_2dp, p.t,
       round(p.density, 6) AS density
FROM panel p JOIN rk ON p.series = rk.series
WHERE rk.rank <= 10
"""


@register("top_corr_series", "WITH " + _RANKED_SQL.format(dir="DESC"))
def q_top_corr_series(spark, sf_dir):
    return rounded(agg.ranked_corr_series(fx.panel(spark, sf_dir), 10, least=False))


@register("bottom_corr_series", "WITH " + _RANKED_SQL.format(dir="ASC"))
def q_bottom_corr_series(spark, sf_dir):
    return rounded(agg.ranked_corr_series(fx.panel(spark, sf_dir), 10, least=True))


@register("group_sizes", """
SELECT state, count(*) AS n_rows, count(DISTINCT series) AS n_series
FROM panel GROUP BY state
""")
def q_group_sizes(spark, sf_dir):
    return agg.group_sizes(fx.panel(spark, sf_dir))


@register("key_coverage", """
SELECT (SELECT count(DISTINCT series) FROM panel) AS panel_keys,
       (SELECT count(DISTINCT series) FROM attrs) AS attr_keys,
       (SELECT count(*) FROM (SELECT DISTINCT series FROM panel
                              WHERE series IN (SELECT series FROM attrs))) AS common_keys
""")
def q_key_coverage(spark, sf_dir):
    return agg.key_coverage(fx.panel(spark, sf_dir), fx.attributes(spark, sf_dir))


@register("common_keys", """
SELECT DISTINCT series FROM attrs WHERE series IN (SELECT series FROM panel)
""")
def q_common_keys(spark, sf_dir):
    return joins.common_keys(fx.attributes(spark, sf_dir), fx.panel(spark, sf_dir))


@register("panel_attr_join", f"""
SELECT p.series, p.county, p.state, p.t, p.active, round(p.density, 6) AS density, {ATTR_SQL}
FROM panel p JOIN attrs a ON p.series = a.series
""")
def q_panel_attr_join(spark, sf_dir):
    return rounded(joins.panel_attr_join(fx.panel(spark, sf_dir), fx.attributes(spark, sf_dir)))


@register("null_profile", """
SELECT county, state, col AS "column", count(*) AS n_nulls
FROM (SELECT p.county, p.state, 'avg_funded_bal' AS col FROM panel p JOIN attrs a USING (series)
      WHERE a.avg_funded_bal IS NULL
      UNION ALL
      SELECT p.county, p.state, 'density' AS col FROM panel p JOIN attrs a USING (series)
      WHERE p.density IS NULL) x
GROUP BY county, state, col
""")
def q_null_profile(spark, sf_dir):
    joined = joins.panel_attr_join(fx.panel(spark, sf_dir), fx.attributes(spark, sf_dir))
    return agg.null_profiles(joined, ["avg_funded_bal", "density"])


@register("complete_rows", f"""
SELECT p.series, p.county, p.state, p.t, p.active, round(p.density, 6) AS density, {ATTR_SQL}
FROM panel p JOIN attrs a ON p.series = a.series
WHERE p.county IS NOT NULL AND p.state IS NOT NULL AND p.density IS NOT NULL
  AND a.avg_acctbal IS NOT NULL AND a.supp_bal IS NOT NULL AND a.avg_supp_bal IS NOT NULL
  AND a.avg_funded_bal IS NOT NULL
""")
def q_complete_rows(spark, sf_dir):
    joined = joins.panel_attr_join(fx.panel(spark, sf_dir), fx.attributes(spark, sf_dir))
    casted = cols.cast_columns(joined, ["active", "density"], ["int", "double"])
    return rounded(cols.complete_rows(casted))


@register("drop_columns", """
SELECT p.series, p.t, p.active, round(p.density, 6) AS density,
       a.customers, a.suppliers, round(a.avg_supp_bal, 6) AS avg_supp_bal,
       round(a.avg_funded_bal, 6) AS avg_funded_bal
FROM panel p JOIN attrs a ON p.series = a.series
""")
def q_drop_columns(spark, sf_dir):
    joined = joins.panel_attr_join(fx.panel(spark, sf_dir), fx.attributes(spark, sf_dir))
    dropped = cols.drop_columns(joined, [
        "county", "state", "avg_acctbal", "share_automobile", "share_building",
        "share_furniture", "share_household", "share_machinery", "supp_bal", "row_id", "no_such_column"])
    return rounded(dropped)


@register("cast_columns", f"SELECT {PANEL_COLS} FROM panel")
def q_cast_columns(spark, sf_dir):
    text = fx.typed_text(spark, sf_dir)
    typed = cols.cast_columns(text, ["series", "county", "state", "t", "active", "density"],
                              ["bigint", "string", "string", "date", "int", "double"])
    return rounded(typed)


@register("csv_roundtrip", f"SELECT {PANEL_COLS} FROM panel")
def q_csv_roundtrip(spark, sf_dir):
    path = write_csv(fx.typed_text(spark, sf_dir), scratch_path(spark, "csv-roundtrip"))
    return rounded(read_csv(spark, path, PANEL_SCHEMA))


@register("csv_read_cast", f"SELECT {PANEL_COLS} FROM panel")
def q_csv_read_cast(spark, sf_dir):
    """S1 + P5: CSV read with a header and no schema (every column a string,
    the reference's load path), then one bulk ``try_cast`` projection."""
    path = write_csv(fx.typed_text(spark, sf_dir), scratch_path(spark, "csv-strings"))
    text = read_csv(spark, path, schema=None)
    typed = cols.cast_columns(text, ["series", "county", "state", "t", "active", "density"],
                              ["bigint", "string", "string", "date", "int", "double"])
    return rounded(typed)


@register("date_parts", """
SELECT series, t, CAST(t AS DATE) AS date, CAST(year(t) AS INTEGER) AS year,
       CAST(month(t) AS INTEGER) AS month, CAST(day(t) AS INTEGER) AS day
FROM panel
""")
def q_date_parts(spark, sf_dir):
    text = fx.typed_text(spark, sf_dir).select("series", "t")
    parsed = cols.date_parts(text, "t")
    return parsed.select(F.col("series").cast("bigint").alias("series"), F.col("date").alias("t"),
                         "date", "year", "month", "day")


@register("month_index", """
SELECT series, t, CAST((year(t) - 2019) * 12 + month(t) - 8 AS INTEGER) AS x FROM panel
""")
def q_month_index(spark, sf_dir):
    return cols.add_month_index(fx.panel(spark, sf_dir)).select("series", "t", "x")


@register("append_panel", """
SELECT series, county, state, t,
       CASE WHEN t IN (SELECT t FROM cal ORDER BY t DESC LIMIT 4) THEN NULL ELSE active END AS active,
       round(density, 6) AS density
FROM panel
""")
def q_append_panel(spark, sf_dir):
    return rounded(joins.append_panel(fx.base_panel(spark, sf_dir), fx.late_panel(spark, sf_dir)))


@register("stream_append", """
SELECT series, county, state, t,
       CASE WHEN t IN (SELECT t FROM cal ORDER BY t DESC LIMIT 4) THEN NULL ELSE active END AS active,
       round(density, 6) AS density
FROM panel
""")
def q_stream_append(spark, sf_dir):
    from ..streaming import stream_append
    return rounded(stream_append(spark, fx.base_panel(spark, sf_dir), fx.late_panel(spark, sf_dir)))


IDS_SQL = """
sid AS (
  SELECT series, CAST(row_number() OVER (ORDER BY series) - 1 AS BIGINT) AS series_id
  FROM (SELECT DISTINCT series FROM panel WHERE series IS NOT NULL) d
),
st AS (
  SELECT state, CAST(row_number() OVER (ORDER BY state) - 1 AS BIGINT) AS state_id
  FROM (SELECT DISTINCT state FROM panel WHERE state IS NOT NULL) d
),
ids AS (
  SELECT p.series, p.state, sid.series_id, st.state_id
  FROM (SELECT series, arg_min(state, t) AS state FROM panel GROUP BY series) p
  LEFT JOIN sid ON sid.series = p.series LEFT JOIN st ON st.state = p.state
)
"""


def id_table(spark, sf_dir):
    """series, state, series_id, state_id: one row per series.  The dense ids
    are attached here, once per series, and every other table looks them up by
    the series key, so nothing large is shuffled on the few states."""
    def build():
        p = fx.panel(spark, sf_dir)
        per_series = p.groupBy("series").agg(F.min_by("state", "t").alias("state"))
        per_series = joins.attach_ids(per_series, joins.dense_ids(p, "series", "series_id"), "series")
        return joins.attach_ids(per_series, joins.dense_ids(per_series, "state", "state_id"), "state").select(
            "series", "state", "series_id", "state_id").checkpoint(eager=True)
    return fx._memoized(spark, ("ids", sf_dir), build)


@register("dense_ids", "WITH " + IDS_SQL + "SELECT series, series_id FROM sid")
def q_dense_ids(spark, sf_dir):
    return joins.dense_ids(fx.panel(spark, sf_dir), "series", "series_id")


@register("panel_ids", "WITH " + IDS_SQL + """
SELECT p.series, p.t, ids.series_id, ids.state_id FROM panel p LEFT JOIN ids ON ids.series = p.series
""")
def q_panel_ids(spark, sf_dir):
    return joins.attach_ids(fx.panel(spark, sf_dir).select("series", "t"),
                            id_table(spark, sf_dir).drop("state"), "series")


@register("future_state_ids", "WITH " + IDS_SQL + """,
fs AS (SELECT series, max(t) AS last_t FROM panel GROUP BY series),
fut AS (
  SELECT fs.series, CAST(x.t AS DATE) AS t
  FROM fs, unnest(generate_series(fs.last_t + INTERVAL 1 MONTH, fs.last_t + INTERVAL 4 MONTH,
                                  INTERVAL 1 MONTH)) AS x(t)
)
SELECT fut.series, fut.t, ids.state, ids.series_id, ids.state_id
FROM fut LEFT JOIN ids ON fut.series = ids.series
""")
def q_future_state_ids(spark, sf_dir):
    return joins.attach_ids(fx.future_panel(spark, sf_dir), id_table(spark, sf_dir), "series").select(
        "series", "t", "state", "series_id", "state_id")


@register("missing_keys", """
SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
""")
def q_missing_keys(spark, sf_dir):
    """Keys without an entry in the other table: documents without a label."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id"]).where(F.col("doc_id").isNotNull())
    return joins.missing_keys(docs, read_table(spark, sf_dir, "labels", ["doc_id"]), "doc_id")


@register("label_coverage", """
SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS panel_keys,
       (SELECT count(DISTINCT doc_id) FROM labels) AS attr_keys,
       (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS common_keys
""")
def q_label_coverage(spark, sf_dir):
    """Key coverage of two tables of which one has keys the other lacks."""
    return agg.key_coverage(read_table(spark, sf_dir, "documents", ["doc_id"]),
                            read_table(spark, sf_dir, "labels", ["doc_id"]), key="doc_id")


@register("series_endpoints", """
SELECT a.series, e.first_state, round(e.last_value, 6) AS last_value, e.last_t
FROM attrs a JOIN (SELECT series, arg_min(state, t) AS first_state,
                          arg_max(density, t) AS last_value, max(t) AS last_t
                   FROM panel GROUP BY series) e ON a.series = e.series
""")
def q_series_endpoints(spark, sf_dir):
    return rounded(agg.series_endpoints(fx.panel(spark, sf_dir), fx.attributes(spark, sf_dir)))


@register("panel_profile", """
SELECT count(*) AS n_rows, count(DISTINCT series) AS n_series, count(DISTINCT t) AS n_periods,
       min(t) AS first_t, max(t) AS last_t,
       count(*) FILTER (WHERE density IS NULL) AS n_null,
       count(*) FILTER (WHERE density = 0) AS n_zero
FROM panel
""")
def q_panel_profile(spark, sf_dir):
    return agg.panel_profile(fx.panel(spark, sf_dir))


@register("mean_series", """
SELECT CAST(0 AS INTEGER) AS series, t, round(avg(density), 6) AS density FROM panel GROUP BY t
""")
def q_mean_series(spark, sf_dir):
    return rounded(agg.mean_series(fx.panel(spark, sf_dir)))
