"""Association queries over lineitem, orders and events."""

from itertools import combinations

from pyspark.sql import functions as F

from glasswork.operators import association as ops
from registry.common import Registry, rounded, table

REG = Registry()
query = REG.query

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pearson_sql(cols, source):
    cells = [f"SELECT '{a}' AS a, '{b}' AS b, ROUND(CORR({a}, {b}), 6) AS value FROM {source}"
             for x, y in combinations(cols, 2) for a, b in ((x, y), (y, x))]
    return " UNION ALL ".join(cells + [f"SELECT '{c}', '{c}', 1E0" for c in cols])


HOLED = "(SELECT * REPLACE (CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS l_quantity) FROM lineitem)"


def lineitem(spark, sf):
    return table(spark, sf, "lineitem").withColumn(
        "l_quantity", F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")))


@query("pearson_matrix", _pearson_sql(NUMS, HOLED))
def _(spark, sf):
    return rounded(ops.pearson_matrix(lineitem(spark, sf).select(NUMS)), "value")


@query("contingency", "SELECT l_returnflag AS va, l_linestatus AS vb, COUNT(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    return ops.contingency(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


def chi_sql(a, b, source):
    """Chi-square over the full grid of expected cells, with Yates' correction on 2x2."""
    return f"""(WITH t AS (SELECT {a} AS va, {b} AS vb FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
o AS (SELECT va, vb, COUNT(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT va, COUNT(*) AS rn FROM t GROUP BY 1),
c AS (SELECT vb, COUNT(*) AS cn FROM t GROUP BY 1), s AS (SELECT (SELECT COUNT(*) FROM t) AS n,
  (SELECT COUNT(*) FROM r) AS r, (SELECT COUNT(*) FROM c) AS k),
e AS (SELECT COALESCE(o.n, 0) AS obs, rn * cn / s.n AS ex, s.r, s.k FROM r CROSS JOIN c CROSS JOIN s
  LEFT JOIN o ON o.va = r.va AND o.vb = c.vb)
SELECT SUM(POW(ABS(obs - ex) - CASE WHEN r = 2 AND k = 2 THEN LEAST(0.5, ABS(obs - ex)) ELSE 0 END, 2) / ex) AS chi2,
  SUM(obs)::BIGINT AS n, ANY_VALUE(r) AS r, ANY_VALUE(k) AS k FROM e)"""


@query("chi2", f"SELECT ROUND(chi2, 4) AS chi2, n, r, k FROM {chi_sql('l_returnflag', 'l_linestatus', 'lineitem')}")
def _(spark, sf):
    cells = ops.contingency(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return rounded(ops.chi2(cells), "chi2", digits=4)


TWO = "(SELECT l_linestatus, l_quantity > 25 AS large FROM lineitem)"


@query("chi2_yates", f"SELECT ROUND(chi2, 4) AS chi2, n, r, k FROM {chi_sql('l_linestatus', 'large', TWO)}")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_linestatus", (F.col("l_quantity") > 25).alias("large"))
    return rounded(ops.chi2(ops.contingency(li, "l_linestatus", "large")), "chi2", digits=4)


CATS = ["l_returnflag", "l_linestatus", "large", "ship"]
CAT_SQL = """(SELECT l_returnflag, CASE WHEN l_partkey % 7 <> 0 THEN l_linestatus END AS l_linestatus,
  l_quantity > 25 AS large, 'm' || MONTH(l_shipdate) AS ship FROM lineitem)"""


def cats(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_returnflag", F.when(F.col("l_partkey") % 7 != 0, F.col("l_linestatus")).alias("l_linestatus"),
        (F.col("l_quantity") > 25).alias("large"), F.concat(F.lit("m"), F.month("l_shipdate").cast("string")).alias("ship"))


def v_sql(names, source):
    cells = []
    for x, y in combinations(names, 2):
        v = f"""SQRT(GREATEST(0, chi2 / n - (k - 1) * (r - 1) / (n - 1))
          / LEAST(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1))"""
        for a, b in ((x, y), (y, x)):
            cells.append(f"SELECT '{a}' AS a, '{b}' AS b, ROUND(LEAST({v}, 1), 6) AS value FROM {chi_sql(x, y, source)}")
    return " UNION ALL ".join(cells + [f"SELECT '{c}', '{c}', 1E0" for c in names])


@query("cramers_v_matrix", v_sql(CATS, CAT_SQL))
def _(spark, sf):
    return rounded(ops.cramers_v_matrix(cats(spark, sf), CATS), "value")


def xi_sql(x, y, key, source, seed="42"):
    return f"""(WITH t AS (SELECT {x} AS x, {y} AS y, MD5('{seed}|' || {key}) AS h FROM {source}),
d AS (SELECT y, SUM(COUNT(*)) OVER (ORDER BY y) AS r, SUM(COUNT(*)) OVER (ORDER BY y DESC) AS l FROM t GROUP BY y),
s AS (SELECT r, l, LAG(r) OVER (ORDER BY x, h) AS q FROM t JOIN d USING (y))
SELECT 1 - COUNT(*)::DOUBLE * SUM(ABS(r - q))::DOUBLE / (2 * SUM(l::DOUBLE * (COUNT_ALL - l))) AS v
FROM s, (SELECT COUNT(*) AS COUNT_ALL FROM t))"""


def xi_matrix_sql(names, key, source):
    cells = [f"SELECT '{a}' AS a, '{b}' AS b, ROUND(GREATEST(LEAST(v, 1), 0), 6) AS value FROM {xi_sql(a, b, key, source)}"
             for a in names for b in names if a != b]
    return " UNION ALL ".join(cells + [f"SELECT '{c}', '{c}', 1E0" for c in names])


EVENT_SQL = "(SELECT event_id, user_id, value, EXTRACT(hour FROM ts) AS hour FROM events)"


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "value", F.hour("ts").cast("bigint").alias("hour"))


@query("xi_matrix", xi_matrix_sql(["user_id", "value", "hour"], "event_id", EVENT_SQL))
def _(spark, sf):
    return rounded(ops.xi_matrix(events(spark, sf), ["user_id", "value", "hour"], ["event_id"]), "value")


ASSOC_SQL = "(SELECT event_id, user_id, value, event_type, CASE WHEN value > 20 THEN 'high' ELSE 'low' END AS band FROM events)"


@query("association", f"""
SELECT 'pearson' AS kind, * FROM ({_pearson_sql(['user_id', 'value'], ASSOC_SQL)})
UNION ALL SELECT 'cramerv', * FROM ({v_sql(['event_type', 'band'], ASSOC_SQL)})
UNION ALL SELECT 'xi', * FROM ({xi_matrix_sql(['user_id', 'value'], 'event_id', ASSOC_SQL)})""")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "value", "event_type",
                                           F.when(F.col("value") > 20, "high").otherwise("low").alias("band"))
    return rounded(ops.association(ev, ["user_id", "value", "event_type", "band"], ["event_id"]), "value")
