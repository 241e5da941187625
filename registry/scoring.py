"""Scoring queries: terms, links, the three model kinds and exported SQL text."""

from pyspark.sql import functions as F

from glasswork.operators import score as ops
from glasswork.streaming.scoring import score_stream  # noqa: F401  (same operator, streaming input)
from registry.common import (BINARY, FLAGS, LINEAR, LOGIT, MULTI, PAIR, PRICE, PRICE_TREE, SOFTMAX, TREE, Registry,
                             r6, rounded, table)

REG = Registry()
query = REG.query

KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey"


def lineitem(spark, sf):
    return table(spark, sf, "lineitem")


def holed(spark, sf):
    """lineitem with a seventh of its quantities and statuses set to null."""
    return lineitem(spark, sf).withColumns({
        "l_quantity": F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")),
        "l_linestatus": F.when(F.col("l_suppkey") % 7 != 0, F.col("l_linestatus")),
    })


HOLED_SQL = f"""(SELECT {KEY_SQL}, l_discount, l_tax, l_extendedprice,
  CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS l_quantity,
  CASE WHEN l_suppkey % 7 <> 0 THEN l_linestatus END AS l_linestatus FROM lineitem) AS h"""


@query("score_numeric_term", f"""
SELECT {KEY_SQL}, CASE WHEN l_quantity <= 5.5 THEN -0.31 WHEN l_quantity > 5.5 AND l_quantity <= 12 THEN -0.12
  WHEN l_quantity > 12 AND l_quantity <= 25 THEN 0.0 WHEN l_quantity > 25 AND l_quantity <= 40 THEN 0.14
  WHEN l_quantity >= 40 THEN 0.27 ELSE 0.0 END::DOUBLE AS l_quantity_score FROM lineitem""")
def _(spark, sf):
    return ops.score_term(lineitem(spark, sf), BINARY.terms[0]).select(*KEYS, "l_quantity_score")


@query("score_numeric_term_balanced", f"""
SELECT {KEY_SQL}, ((l_quantity - 25.5) * 2010.5)::DOUBLE AS l_quantity_score FROM lineitem""")
def _(spark, sf):
    return ops.score_term(lineitem(spark, sf), PRICE.terms[0]).select(*KEYS, "l_quantity_score")


@query("score_categorical_term", f"""
SELECT {KEY_SQL}, CASE WHEN l_linestatus = 'F' THEN 0.33 WHEN l_linestatus = 'O' THEN -0.29 ELSE 0.0
  END::DOUBLE AS l_linestatus_score FROM lineitem""")
def _(spark, sf):
    return ops.score_term(lineitem(spark, sf), BINARY.terms[2]).select(*KEYS, "l_linestatus_score")


@query("score_categorical_join", f"""
WITH lookup AS (SELECT p_brand AS category, AVG(p_retailprice) - 900 AS score FROM part GROUP BY p_brand)
SELECT o_orderkey, ROUND(COALESCE(score, 0), 6) AS brand_score
FROM (SELECT o_orderkey, 'Brand#' || (o_custkey % 40) AS brand FROM orders) LEFT JOIN lookup ON brand = category""")
def _(spark, sf):
    lookup = table(spark, sf, "part").groupBy(F.col("p_brand").alias("category")).agg(
        (F.avg("p_retailprice") - 900).alias("score"))
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("Brand#"), (F.col("o_custkey") % 40).cast("string")).alias("brand"))
    out = ops.score_categories(orders, "brand", lookup)
    return rounded(out.select("o_orderkey", "brand_score"), "brand_score")


@query("score_missing", f"""
SELECT {KEY_SQL}, CASE WHEN l_quantity IS NULL THEN 0.05 WHEN l_quantity <= 5.5 THEN -0.31
  WHEN l_quantity <= 12 THEN -0.12 WHEN l_quantity <= 25 THEN 0.0 WHEN l_quantity <= 40 THEN 0.14 ELSE 0.27
  END::DOUBLE AS l_quantity_score FROM {HOLED_SQL}""")
def _(spark, sf):
    return ops.score_term(holed(spark, sf), BINARY.terms[0]).select(*KEYS, "l_quantity_score")


@query("score_pair_term", f"""
SELECT {KEY_SQL}, COALESCE(s, 0)::DOUBLE AS l_quantity_x_l_linestatus_score
FROM {HOLED_SQL} LEFT JOIN (VALUES
  (0, 0, 0.01), (0, 1, 0.02), (0, 2, 0.03), (1, 0, 0.1), (1, 1, -0.2), (1, 2, 0.3),
  (2, 0, 0.11), (2, 1, -0.21), (2, 2, 0.31), (3, 0, 0.12), (3, 1, -0.22), (3, 2, 0.32),
  (4, 0, 0.13), (4, 1, -0.23), (4, 2, 0.33)) AS g(i, j, s)
ON i = CASE WHEN l_quantity IS NULL THEN 0 WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 20 THEN 2
            WHEN l_quantity <= 35 THEN 3 ELSE 4 END
AND j = CASE WHEN l_linestatus IS NULL THEN 0 WHEN l_linestatus = 'F' THEN 1 WHEN l_linestatus = 'O' THEN 2 END""")
def _(spark, sf):
    name = "l_quantity_x_l_linestatus_score"
    return ops.score_term(holed(spark, sf), PAIR).select(*KEYS, name)


# Written out by hand, bin by bin, so the renderer under test has no part in its own oracle.
BINARY_SUM_SQL = """(-0.6931E0
  + CASE WHEN l_quantity <= 5.5 THEN -0.31E0 WHEN l_quantity <= 12 THEN -0.12E0 WHEN l_quantity <= 25 THEN 0E0
         WHEN l_quantity <= 40 THEN 0.14E0 ELSE 0.27E0 END
  + CASE WHEN l_discount <= 0.015E0 THEN 0.21E0 WHEN l_discount <= 0.045E0 THEN 0.08E0
         WHEN l_discount <= 0.075E0 THEN -0.06E0 ELSE -0.24E0 END
  + CASE l_linestatus WHEN 'F' THEN 0.33E0 WHEN 'O' THEN -0.29E0 ELSE 0E0 END)"""
PRICE_SUM_SQL = """(52000E0 + (l_quantity - 25.5E0) * 2010.5E0
  + CASE WHEN l_tax <= 0.025E0 THEN -35.5E0 WHEN l_tax <= 0.055E0 THEN 12.25E0 ELSE 20.75E0 END
  + CASE WHEN l_discount <= 0.05E0 THEN CASE WHEN l_tax <= 0.04E0 THEN 3.5E0 ELSE -2.5E0 END
         ELSE CASE WHEN l_tax <= 0.04E0 THEN -4.25E0 ELSE 1.75E0 END END)"""


@query("additive_probability", f"""
SELECT {KEY_SQL}, ROUND(s, 6) AS score, ROUND(1 / (1 + EXP(-s)), 6) AS probability
FROM (SELECT {KEY_SQL}, {BINARY_SUM_SQL} AS s FROM lineitem)""")
def additive_probability(spark, sf):
    out = ops.score(lineitem(spark, sf), BINARY).select(*KEYS, "score", "probability")
    return rounded(out, "score", "probability")


@query("sigmoid_overflow_safe", """
SELECT o_orderkey, ROUND(CASE WHEN o_totalprice > 250700 THEN 1E0 WHEN o_totalprice < 249300 THEN 0E0
  ELSE 1 / (1 + EXP(250000E0 - o_totalprice)) END, 6) AS probability FROM orders""")
def _(spark, sf):
    from glasswork.functions.scoring import sigmoid_text

    return table(spark, sf, "orders").select("o_orderkey", r6(F.expr(sigmoid_text("o_totalprice - 250000"))).alias("probability"))


@query("regression_output", f"""
SELECT {KEY_SQL}, ROUND(52000 + COALESCE((l_quantity - 25.5) * 2010.5, 0)
  + CASE WHEN l_tax <= 0.025 THEN -35.5 WHEN l_tax <= 0.055 THEN 12.25 ELSE 20.75 END
  + CASE WHEN l_discount <= 0.05 THEN CASE WHEN l_tax <= 0.04 THEN 3.5 ELSE -2.5 END
         ELSE CASE WHEN l_tax <= 0.04 THEN -4.25 ELSE 1.75 END END, 6)::DOUBLE AS prediction
FROM {HOLED_SQL}""")
def _(spark, sf):
    return rounded(ops.score(holed(spark, sf), PRICE).select(*KEYS, "prediction"), "prediction")


MULTI_SQL = f"""
WITH s AS (SELECT {KEY_SQL},
  -0.2 + CASE WHEN l_quantity IS NULL THEN 0 WHEN l_quantity <= 15 THEN 0.2 WHEN l_quantity <= 35 THEN 0.0 ELSE -0.3 END
    + CASE l_linestatus WHEN 'F' THEN 0.4 WHEN 'O' THEN -0.45 ELSE 0 END AS a,
  0.3 + CASE WHEN l_quantity IS NULL THEN 0 WHEN l_quantity <= 15 THEN -0.1 WHEN l_quantity <= 35 THEN 0.15 ELSE 0.1 END
    + CASE l_linestatus WHEN 'F' THEN -0.6 WHEN 'O' THEN 0.5 ELSE 0 END AS n,
  -0.1 + CASE WHEN l_quantity IS NULL THEN 0 WHEN l_quantity <= 15 THEN 0.05 WHEN l_quantity <= 35 THEN -0.05 ELSE 0.25 END
    + CASE l_linestatus WHEN 'F' THEN 0.35 WHEN 'O' THEN -0.4 ELSE 0 END AS r FROM {HOLED_SQL})"""


@query("multiclass_term_scores", MULTI_SQL + f"""
SELECT {KEY_SQL}, ROUND(a, 6)::DOUBLE AS score_a, ROUND(n, 6)::DOUBLE AS score_n, ROUND(r, 6)::DOUBLE AS score_r FROM s""")
def _(spark, sf):
    out = ops.class_vectors(holed(spark, sf), MULTI)
    return out.select(*KEYS, *[r6(F.col("class_scores")[k]).alias(f"score_{c.lower()}") for k, c in enumerate(FLAGS)])


@query("multiclass_softmax_label", MULTI_SQL + f""", e AS (
  SELECT *, EXP(a::DOUBLE) AS ea, EXP(n::DOUBLE) AS en, EXP(r::DOUBLE) AS er FROM s)
SELECT {KEY_SQL}, ROUND(ea / (ea + en + er), 6) AS "probability_A", ROUND(en / (ea + en + er), 6) AS "probability_N",
  ROUND(er / (ea + en + er), 6) AS "probability_R",
  CASE WHEN a >= n AND a >= r THEN 'A' WHEN n >= r THEN 'N' ELSE 'R' END AS prediction FROM e""")
def _(spark, sf):
    out = ops.predict(holed(spark, sf), MULTI)
    probs = ops.probability_columns(MULTI)
    return rounded(out.select(*KEYS, *probs, "prediction"), *probs)


@query("linear_terms", f"""
SELECT {KEY_SQL}, ROUND(1250.5 + 2047.25 * l_quantity - 815.5 * l_discount, 4)::DOUBLE AS prediction FROM {HOLED_SQL}""")
def _(spark, sf):
    return rounded(ops.score(holed(spark, sf), LINEAR).select(*KEYS, "prediction"), "prediction", digits=4)


@query("linear_probability", f"""
SELECT {KEY_SQL}, ROUND(1 / (1 + EXP(-(-0.75E0 + 0.0125E0 * l_quantity - 1.5E0 * l_discount + 2.25E0 * l_tax))), 6)
  AS probability FROM {HOLED_SQL}""")
def _(spark, sf):
    return rounded(ops.score(holed(spark, sf), LOGIT).select(*KEYS, "probability"), "probability")


@query("linear_multiclass", f"""
WITH s AS (SELECT {KEY_SQL}, 0.1E0 + 0.011E0 * l_quantity - 0.5E0 * l_tax AS a,
  -0.2E0 - 0.004E0 * l_quantity + 1.5E0 * l_tax AS n, 0.05E0 + 0.002E0 * l_quantity + 0.25E0 * l_tax AS r FROM {HOLED_SQL})
SELECT {KEY_SQL}, ROUND(EXP(a) / (EXP(a) + EXP(n) + EXP(r)), 6) AS "probability_A",
  ROUND(EXP(n) / (EXP(a) + EXP(n) + EXP(r)), 6) AS "probability_N",
  ROUND(EXP(r) / (EXP(a) + EXP(n) + EXP(r)), 6) AS "probability_R",
  CASE WHEN a IS NULL THEN NULL WHEN a >= n AND a >= r THEN 'A' WHEN n >= r THEN 'N' ELSE 'R' END AS prediction FROM s""")
def _(spark, sf):
    probs = ops.probability_columns(SOFTMAX)
    out = ops.predict(holed(spark, sf), SOFTMAX).select(*KEYS, *probs, "prediction")
    return rounded(out, *probs)


@query("tree_score", f"""
SELECT {KEY_SQL}, CASE WHEN l_quantity <= 24.5 THEN CASE WHEN l_discount <= 0.045 THEN 'A' ELSE 'N' END ELSE 'N' END
  AS prediction, ROUND(CASE WHEN l_quantity <= 24.5 THEN CASE WHEN l_discount <= 0.045 THEN 12.0/19 ELSE 3.0/11 END
  ELSE 5.0/50 END, 6)::DOUBLE AS "probability_A" FROM {HOLED_SQL}""")
def _(spark, sf):
    out = ops.score(holed(spark, sf), TREE).select(*KEYS, "prediction", "probability_A")
    return rounded(out, "probability_A")


@query("tree_score_regression", f"""
SELECT {KEY_SQL}, CASE WHEN l_quantity <= 25.5 THEN CASE WHEN l_quantity <= 12.5 THEN 14000.75 ELSE 40000.5 END
  ELSE CASE WHEN l_tax <= 0.045 THEN 77500.125 ELSE 78500.5 END END::DOUBLE AS prediction FROM {HOLED_SQL}""")
def _(spark, sf):
    return ops.score(holed(spark, sf), PRICE_TREE).select(*KEYS, "prediction")


@query("leaf_stats", """
WITH c AS (SELECT CASE WHEN l_quantity <= 24.5 THEN CASE WHEN l_discount <= 0.045 THEN 3 ELSE 4 END ELSE 2 END AS leaf,
  l_returnflag AS y, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT leaf, SUM(n)::BIGINT AS "rows", ARG_MAX(y, n) AS majority, ROUND(MAX(n) / SUM(n), 6)::DOUBLE AS share
FROM c GROUP BY leaf""")
def _(spark, sf):
    return rounded(ops.leaf_stats(lineitem(spark, sf), TREE), "share")


@query("score_split_sql", f"SELECT ROUND({PRICE_SUM_SQL}, 6) AS prediction, COUNT(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    out = ops.run_sql_model(ops.export_sql(PRICE, split=True), lineitem(spark, sf))
    return rounded(out, "prediction").groupBy("prediction").agg(F.count("*").alias("n"))


@query("run_sql_model", f"SELECT ROUND(1 / (1 + EXP(-{BINARY_SUM_SQL})), 6) AS probability, COUNT(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    out = ops.run_sql_model(ops.export_sql(BINARY), lineitem(spark, sf))
    return rounded(out, "probability").groupBy("probability").agg(F.count("*").alias("n"))


@query("export_multiclass_sql", MULTI_SQL.replace(HOLED_SQL, "lineitem") + """, e AS (
  SELECT *, EXP(a::DOUBLE) AS ea, EXP(n::DOUBLE) AS en, EXP(r::DOUBLE) AS er FROM s)
SELECT CASE WHEN a >= n AND a >= r THEN 'A' WHEN n >= r THEN 'N' ELSE 'R' END AS prediction,
  ROUND(en / (ea + en + er), 6) AS probability_n, COUNT(*) AS n FROM e GROUP BY 1, 2""")
def _(spark, sf):
    out = ops.run_sql_model(ops.export_sql(MULTI, split=True), lineitem(spark, sf))
    return out.groupBy("prediction", r6("probability_N").alias("probability_n")).agg(F.count("*").alias("n"))


@query("export_tree_sql", f"""
SELECT prediction, COUNT(*) AS n FROM (SELECT CASE WHEN l_quantity <= 24.5 AND l_discount <= 0.045 THEN 'A' ELSE 'N' END
AS prediction FROM lineitem) GROUP BY 1""")
def _(spark, sf):
    out = ops.run_sql_model(ops.export_sql(TREE), lineitem(spark, sf))
    return out.groupBy("prediction").agg(F.count("*").alias("n"))


@query("score_parity", "SELECT COUNT(*) AS \"rows\", 0E0 AS max_diff, TRUE AS ok FROM orders")
def _(spark, sf):
    from glasswork.models import AdditiveModel, numeric_axis, single_term

    model = AdditiveModel("total", "binary", "y", (0.1,), (single_term(
        "o_totalprice", "numeric", numeric_axis([100000.0, 250000.0]), [0.0, -0.4, 0.1, 0.3]),), (0, 1))
    orders = table(spark, sf, "orders")
    columns = ops.score(orders, model)
    text = ops.run_sql_model(
        ops.export_sql(model, split=True).replace("'total' AS model_name", "'total' AS model_name, o_orderkey"), orders)
    return rounded(ops.score_parity(columns, text, "o_orderkey", "probability", "probability"), "max_diff")


# An axis of 100,000 bins over prices with two decimals: no price sits on a cut, and a bin's score follows from its number.
WIDE = 100_000
WIDE_BIN_SQL = f"LEAST(GREATEST(CAST(FLOOR(l_extendedprice - 0.505) AS BIGINT) + 1, 0), {WIDE - 1})"
WIDE_SQL = f"SELECT score, COUNT(*) AS n FROM (SELECT ROUND(({WIDE_BIN_SQL} * 7919 % 1000) / 1000.0 - 0.5, 6)::DOUBLE AS score FROM lineitem) GROUP BY 1"


@query("score_wide_axis", WIDE_SQL)
def _(spark, sf):
    """A numeric axis too wide for a CASE, searched inside the row."""
    from glasswork.models import numeric_axis, single_term

    term = single_term("l_extendedprice", "numeric", numeric_axis([i + 0.505 for i in range(WIDE - 1)]),
                       [0.0, *[i * 7919 % 1000 / 1000 - 0.5 for i in range(WIDE)]])
    out = ops.score_term(table(spark, sf, "lineitem"), term)
    return out.groupBy(r6("l_extendedprice_score").alias("score")).agg(F.count("*").alias("n"))


@query("score_interval_join", WIDE_SQL)
def _(spark, sf):
    """The same axis as a table of intervals."""
    from glasswork.operators.intervals import interval_lookup

    i = F.col("id")
    cells = spark.range(WIDE).select(
        F.when(i > 0, i - 1 + 0.505).alias("lo"), F.when(i < WIDE - 1, i + 0.505).alias("hi"),
        ((i * 7919 % 1000) / 1000 - 0.5).alias("score"))
    out = interval_lookup(table(spark, sf, "lineitem"), "l_extendedprice", cells, "found")
    return out.groupBy(r6("found").alias("score")).agg(F.count("*").alias("n"))


@query("calibrated_tree_sql", """
WITH t AS (SELECT CASE WHEN l_quantity <= 24.5 THEN 0.25E0 ELSE 0.75E0 END AS p FROM lineitem)
SELECT (p > 0.5)::INTEGER AS prediction, p AS probability, ROUND(1 / (1 + EXP(-(2 * p - 1.5))), 6) AS calibrated, COUNT(*) AS n FROM t GROUP BY 1, 2, 3""")
def _(spark, sf):
    """A tree's exported text with its calibrator, next to nothing but SQL."""
    from glasswork.models import Node, TreeModel
    from glasswork.operators.calibrate import Platt

    tree = TreeModel("small", "binary", "y", ("l_quantity",), (
        Node(0, (1.0, 1.0), 2.0, "l_quantity", 24.5, 1, 2, 0.1), Node(1, (3.0, 1.0), 1.0), Node(2, (1.0, 3.0), 1.0)), (0, 1))
    out = ops.run_sql_model(ops.export_sql(tree, calibrator=Platt(2.0, -1.5)), table(spark, sf, "lineitem"))
    return out.groupBy("prediction", "probability", r6("calibrated_probability").alias("calibrated")).agg(F.count("*").alias("n"))
