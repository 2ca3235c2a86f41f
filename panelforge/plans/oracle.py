"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The fixtures are defined once as CTEs (``FIXTURE_CTES``) with the same
definition as ``plans.fixtures``; each oracle query is ``WITH <ctes> <body>``.
Doubles are rounded to 6 decimals on both sides and integer widths are cast
explicitly so names, types and values line up with the Spark results.
"""

from __future__ import annotations

# Fixed values of the fixture definition (same as plans.fixtures).
ANCHOR_SQL = "DATE '2000-01-01'"
FUNDED_BALANCE_SQL = "5000.0"

FIXTURE_CTES = f"""
cal AS (
  SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS t
  FROM lineitem WHERE l_shipdate IS NOT NULL
),
pop AS (
  SELECT c_nationkey AS nation, count(*) AS customers, avg(c_acctbal) AS avg_acctbal,
         avg(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1.0 ELSE 0.0 END) AS share_automobile,
         avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END) AS share_building,
         avg(CASE WHEN c_mktsegment = 'FURNITURE' THEN 1.0 ELSE 0.0 END) AS share_furniture,
         avg(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1.0 ELSE 0.0 END) AS share_household,
         avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END) AS share_machinery
  FROM customer GROUP BY c_nationkey
),
ser AS (
  SELECT s.s_suppkey AS series, s.s_name AS county, n.n_name AS state, pop.customers
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN pop ON pop.nation = s.s_nationkey
),
cnt AS (
  SELECT l_suppkey AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS t, count(*) AS active
  FROM lineitem WHERE l_shipdate IS NOT NULL
  GROUP BY 1, 2
),
panel AS (
  SELECT s.series, s.county, s.state, cal.t,
         CAST(coalesce(cnt.active, 0) AS INTEGER) AS active,
         CAST(coalesce(cnt.active, 0) AS DOUBLE) * 100.0 / s.customers AS density
  FROM ser s CROSS JOIN cal
  LEFT JOIN cnt ON cnt.series = s.series AND cnt.t = cal.t
),
attrs AS (
  SELECT s.s_suppkey AS series, c.customers, c.avg_acctbal, c.share_automobile, c.share_building,
         c.share_furniture, c.share_household, c.share_machinery, g.suppliers,
         s.s_acctbal AS supp_bal, g.avg_supp_bal, g.avg_funded_bal
  FROM supplier s
  LEFT JOIN pop c ON c.nation = s.s_nationkey
  LEFT JOIN (
    SELECT s_nationkey AS nation, count(*) AS suppliers, avg(s_acctbal) AS avg_supp_bal,
           avg(CASE WHEN s_acctbal > {FUNDED_BALANCE_SQL} THEN s_acctbal END) AS avg_funded_bal
    FROM supplier GROUP BY s_nationkey
  ) g ON g.nation = s.s_nationkey
),
ncal AS (SELECT count(*) AS n_periods FROM cal)
"""


def positive_zero_rounds(sql: str) -> str:
    """Rewrite every ``round(...)`` call as ``(round(...) + 0.0)``.

    DuckDB rounds a tiny negative double to -0.0 while Spark's ``round``
    (through BigDecimal) gives +0.0; adding 0.0 turns -0.0 into +0.0 and
    leaves every other value unchanged, so the two results hash alike."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = positive_zero_rounds(sql[j + 6:k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


def with_fixtures(body: str) -> str:
    """Prefix ``body`` with the fixture CTEs.  A body that starts with its
    own ``WITH`` (or ``WITH RECURSIVE``) has its CTEs appended after them."""
    text = body.strip()
    head = "WITH "
    upper = text.upper()
    if upper.startswith("WITH RECURSIVE"):
        head, text = "WITH RECURSIVE ", text[len("WITH RECURSIVE"):].strip()
        return head + FIXTURE_CTES.strip() + ",\n" + text
    if upper.startswith("WITH"):
        return head + FIXTURE_CTES.strip() + ",\n" + text[len("WITH"):].strip()
    return head + FIXTURE_CTES.strip() + "\n" + text
