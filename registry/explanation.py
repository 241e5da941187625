"""Explanation queries with the fixed models."""

from pyspark.sql import functions as F

from glasswork.models import AdditiveModel, numeric_axis, single_term
from glasswork.operators import explain as ops
from glasswork.operators.tree import fit_tree, gini_importance, leaf_class_coverage
from registry.common import BINARY, LOGIT, TREE, Registry, rounded, table

REG = Registry()
query = REG.query

TERMS = {
    "l_quantity": "CASE WHEN l_quantity <= 5.5 THEN -0.31 WHEN l_quantity <= 12 THEN -0.12 WHEN l_quantity <= 25 THEN 0 WHEN l_quantity <= 40 THEN 0.14 ELSE 0.27 END",
    "l_discount": "CASE WHEN l_discount <= 0.015 THEN 0.21 WHEN l_discount <= 0.045 THEN 0.08 WHEN l_discount <= 0.075 THEN -0.06 ELSE -0.24 END",
    "l_linestatus": "CASE WHEN l_linestatus = 'F' THEN 0.33 WHEN l_linestatus = 'O' THEN -0.29 ELSE 0 END",
}


@query("term_importance", " UNION ALL ".join(
    f"SELECT '{t}' AS term, ROUND(AVG(ABS({e}::DOUBLE)), 6) AS importance FROM lineitem" for t, e in TERMS.items()))
def _(spark, sf):
    return rounded(ops.term_importance(table(spark, sf, "lineitem"), BINARY), "importance")


COEFS = {"l_quantity": 0.0125, "l_discount": -1.5, "l_tax": 2.25}


@query("linear_importance", " UNION ALL ".join(
    f"SELECT '{f}' AS term, ROUND(AVG(ABS({c}E0 * {f})), 6) AS importance FROM lineitem" for f, c in COEFS.items()))
def _(spark, sf):
    return rounded(ops.linear_importance(table(spark, sf, "lineitem"), LOGIT), "importance")


@query("shape_function", """
SELECT 'l_quantity' AS term, position, score::DOUBLE AS score, (SELECT COUNT(*) FROM lineitem WHERE l_quantity > lo AND l_quantity <= hi) AS "rows"
FROM (VALUES (0, 0.05, NULL, NULL), (1, -0.31, '-inf'::DOUBLE, 5.5), (2, -0.12, 5.5, 12), (3, 0.0, 12, 25), (4, 0.14, 25, 40),
  (5, 0.27, 40, 'inf'::DOUBLE)) AS v(position, score, lo, hi)
UNION ALL SELECT 'l_discount', position, score::DOUBLE AS score, (SELECT COUNT(*) FROM lineitem WHERE l_discount > lo AND l_discount <= hi)
FROM (VALUES (0, 0.0, NULL, NULL), (1, 0.21, '-inf'::DOUBLE, 0.015), (2, 0.08, 0.015, 0.045), (3, -0.06, 0.045, 0.075),
  (4, -0.24, 0.075, 'inf'::DOUBLE)) AS v(position, score, lo, hi)
UNION ALL SELECT 'l_linestatus', position, score::DOUBLE AS score, (SELECT COUNT(*) FROM lineitem WHERE l_linestatus = c)
FROM (VALUES (0, 0.0, NULL), (1, 0.33, 'F'), (2, -0.29, 'O')) AS v(position, score, c)""")
def _(spark, sf):
    out = ops.shape_function(table(spark, sf, "lineitem"), BINARY)
    return out.select("term", "position", F.col("scores")[0].alias("score"), "rows")


@query("gini_importance")
def _(spark, sf):
    features = ["l_quantity", "l_discount", "l_tax"]
    model = fit_tree(table(spark, sf, "lineitem"), "l_returnflag", features, "multiclass", max_depth=4)
    return gini_importance(spark, model)


@query("leaf_class_coverage", """
WITH l AS (SELECT DISTINCT CASE WHEN l_quantity <= 24.5 THEN CASE WHEN l_discount <= 0.045 THEN 3 ELSE 4 END ELSE 2 END AS leaf FROM lineitem),
c AS (SELECT CASE leaf WHEN 3 THEN 'A' ELSE 'N' END AS class, COUNT(*) AS leaves FROM l GROUP BY 1)
SELECT f.class, COALESCE(leaves, 0) AS leaves, leaves IS NOT NULL AS covered
FROM (SELECT DISTINCT l_returnflag AS class FROM lineitem) AS f LEFT JOIN c USING (class)""")
def _(spark, sf):
    return leaf_class_coverage(table(spark, sf, "lineitem"), TREE)


@query("explain_all_rows", " UNION ALL ".join(
    f"SELECT '{t}' AS term, {t}::VARCHAR AS value, ROUND(SUM({e}::DOUBLE), 4) AS contribution, COUNT(*) AS n FROM lineitem GROUP BY 2"
    for t, e in TERMS.items()))
def _(spark, sf):
    out = ops.explain_rows(table(spark, sf, "lineitem"), BINARY, ["l_orderkey"], n=None)
    return out.groupBy("term", "value").agg(F.round(F.sum("contribution"), 4).alias("contribution"), F.count("*").alias("n"))


ORDER_MODEL = AdditiveModel("total", "binary", "y", (0.1,), (
    single_term("o_totalprice", "numeric", numeric_axis([100000.0, 250000.0]), [0.0, -0.4, 0.1, 0.3]),
    single_term("o_custkey", "numeric", numeric_axis([500.0]), [0.0, 0.25, -0.25])), (0, 1))


@query("explain_rows", """
WITH s AS (SELECT * FROM orders ORDER BY MD5('42|' || o_orderkey) LIMIT 10)
SELECT o_orderkey, 'o_totalprice' AS term, CASE WHEN o_totalprice <= 100000 THEN -0.4 WHEN o_totalprice <= 250000 THEN 0.1 ELSE 0.3 END::DOUBLE AS contribution FROM s
UNION ALL SELECT o_orderkey, 'o_custkey', CASE WHEN o_custkey <= 500 THEN 0.25 ELSE -0.25 END::DOUBLE FROM s""")
def _(spark, sf):
    out = ops.explain_rows(table(spark, sf, "orders"), ORDER_MODEL, ["o_orderkey"])
    return out.select("o_orderkey", "term", "contribution")
