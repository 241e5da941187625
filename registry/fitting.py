"""Fitting queries. Targets are chosen so that the right answer has a closed form where one exists."""

from pyspark.sql import functions as F

from glasswork.operators import calibrate as cal
from glasswork.operators.additive import fit_additive
from glasswork.operators.binning import bin_features, category_counts
from glasswork.operators.linear import cross_fit_linear, fit_linear, fit_logistic
from glasswork.operators.score import predict, probability_columns
from glasswork.operators.splits import kfold
from glasswork.operators.tree import fit_tree
from glasswork.plans.flows import cross_fit
from registry.common import LINEAR, SCORED_SQL, Registry, r6, rounded, scored, table

REG = Registry()
query = REG.query

# An additive target: steps in quantity and discount plus a status effect.
STEPS_SQL = """10 * (l_quantity > 20)::INTEGER + 5 * (l_quantity > 40)::INTEGER + 3 * (l_discount > 0.05)::INTEGER
  + 2 * (l_linestatus = 'F')::INTEGER"""


def step_rows(spark, sf):
    q, d = F.col("l_quantity"), F.col("l_discount")
    steps = ((q > 20).cast("int") * 10 + (q > 40).cast("int") * 5 + (d > 0.05).cast("int") * 3
             + (F.col("l_linestatus") == "F").cast("int") * 2)
    both = ((q > 25) & (d > 0.05)).cast("int") * 4
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_linestatus", "l_returnflag",
        F.concat(F.lit("m"), F.month("l_shipdate").cast("string")).alias("ship"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_linestatus")).alias("status"),
        steps.cast("double").alias("steps"), (steps + both).cast("double").alias("crossed"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"))


@query("bin_features", """
WITH q AS (SELECT quantile_disc(l_quantity, [i / 8 FOR i IN range(1, 8)]) AS a, quantile_disc(l_discount, [i / 8 FOR i IN range(1, 8)]) AS b,
  MAX(l_quantity) AS ma, MAX(l_discount) AS mb FROM lineitem)
SELECT DISTINCT 'l_quantity' AS feature, UNNEST(a) AS cut FROM q UNION ALL
SELECT DISTINCT 'l_discount', UNNEST(b) FROM q""")
def _(spark, sf):
    axes = bin_features(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], max_bins=8, accuracy=10_000_000)
    rows = [(f, c.hi) for f, axis in axes.items() for c in axis if c.hi is not None and c.hi != float("inf")]
    return spark.createDataFrame(rows, "feature string, cut double")


@query("category_counts", """
SELECT 'l_returnflag' AS feature, l_returnflag AS category, COUNT(*) AS n FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, COUNT(*) FROM lineitem GROUP BY 2""")
def _(spark, sf):
    return category_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("ebm_regression", f"""
SELECT l_orderkey, l_linenumber, l_partkey, ROUND({STEPS_SQL}, 3)::DOUBLE AS prediction FROM lineitem""")
def _(spark, sf):
    rows = step_rows(spark, sf)
    model = fit_additive(rows, "steps", ["l_quantity", "l_discount", "l_linestatus"], "regression", bags=1)
    out = predict(rows, model).select("l_orderkey", "l_linenumber", "l_partkey", "prediction")
    return rounded(out, "prediction", digits=3)


@query("ebm_interactions", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
  ROUND({STEPS_SQL} + 4 * (l_quantity > 25 AND l_discount > 0.05)::INTEGER, 0)::DOUBLE AS prediction FROM lineitem""")
def _(spark, sf):
    """Single terms are fitted first, so the pair term recovers the target up to a small remainder."""
    rows = step_rows(spark, sf)
    model = fit_additive(rows, "crossed", ["l_quantity", "l_discount", "l_linestatus"], "regression", bags=1,
                         interactions=1)
    out = predict(rows, model).select("l_orderkey", "l_linenumber", "l_partkey", "prediction")
    return rounded(out, "prediction", digits=0)


SHIP = "'m' || MONTH(l_shipdate)"


@query("ebm_binary", f"""
SELECT {SHIP} AS ship, ROUND(AVG(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 4)::DOUBLE AS probability FROM lineitem GROUP BY 1""")
def _(spark, sf):
    """One categorical feature: the fitted probability is the share of positives per category."""
    rows = step_rows(spark, sf)
    model = fit_additive(rows, "y", ["ship"], "binary", rounds=1000, bags=1)
    return rounded(predict(rows, model).select("ship", "probability").distinct(), "probability", digits=4)


@query("ebm_multiclass", f"""
SELECT {SHIP} AS ship, ROUND(AVG((l_returnflag = 'A')::INTEGER), 3)::DOUBLE AS "probability_A",
  ROUND(AVG((l_returnflag = 'N')::INTEGER), 3)::DOUBLE AS "probability_N",
  ROUND(AVG((l_returnflag = 'R')::INTEGER), 3)::DOUBLE AS "probability_R" FROM lineitem GROUP BY 1""")
def _(spark, sf):
    rows = step_rows(spark, sf)
    model = fit_additive(rows, "l_returnflag", ["ship"], "multiclass", rounds=1000, passes=20, bags=1)
    probs = probability_columns(model)
    return rounded(predict(rows, model).select("ship", *probs).distinct(), *probs, digits=3)


@query("ebm_all_features")
def _(spark, sf):
    """A binary model on mixed features with missing values: its lookup table."""
    from glasswork.sources.store import extract_lookup

    rows = step_rows(spark, sf)
    model = fit_additive(rows, "y", ["l_quantity", "l_discount", "status", "ship"], "binary", interactions=1)
    return extract_lookup(spark, model)


# A maximum likelihood fit of one score per bin reproduces the number of rows of each class in every bin.
BINS_SQL = f"""(SELECT l_returnflag, UNNEST(['discount', 'status', 'ship']) AS feature,
  UNNEST([ROUND(l_discount * 100)::INTEGER::VARCHAR, CASE WHEN l_partkey % 7 <> 0 THEN l_linestatus END, {SHIP}]) AS bin FROM lineitem)"""


def _per_bin(df, sums):
    """Sums per bin of the three features."""
    bins = F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("string").alias("bin")) for n, c in (
        ("discount", F.round(F.col("l_discount") * 100).cast("int")), ("status", F.col("status")), ("ship", F.col("ship")))])
    return df.select("*", F.explode(bins).alias("s")).groupBy("s.feature", "s.bin").agg(*sums)


@query("ebm_binary_features", f"""
SELECT feature, bin, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS expected FROM {BINS_SQL} GROUP BY 1, 2""")
def _(spark, sf):
    """Three features, one with missing values: the probabilities add up to the positives in every bin."""
    model = fit_additive(step_rows(spark, sf), "y", ["l_discount", "status", "ship"], "binary", bags=1)
    out = predict(step_rows(spark, sf), model)
    return _per_bin(out, [F.count(F.lit(1)).alias("n"), F.round(F.sum("probability"), 0).cast("bigint").alias("expected")])


@query("ebm_multiclass_features", f"""
SELECT feature, bin, COUNT(*) FILTER (WHERE l_returnflag = 'A') AS a, COUNT(*) FILTER (WHERE l_returnflag = 'N') AS n,
  COUNT(*) FILTER (WHERE l_returnflag = 'R') AS r FROM {BINS_SQL} GROUP BY 1, 2""")
def _(spark, sf):
    """The same for three classes."""
    model = fit_additive(step_rows(spark, sf), "l_returnflag", ["l_discount", "status", "ship"], "multiclass", bags=1)
    out = predict(step_rows(spark, sf), model)
    return _per_bin(out, [F.round(F.sum(f"probability_{c}"), 0).cast("bigint").alias(c.lower()) for c in "ANR"])


@query("ebm_stderr", """
WITH o AS (SELECT o_orderpriority AS c, o_totalprice AS y, ('0x' || SUBSTR(MD5('bag|' || o_orderkey), 1, 8))::BIGINT % 8 AS bag FROM orders),
r AS (SELECT c, bag, y - AVG(y) OVER (PARTITION BY c) AS e FROM o),
g AS (SELECT c, bag, SUM(e) AS g, COUNT(*) AS h FROM r GROUP BY 1, 2),
s AS (SELECT c, (SUM(g) OVER (PARTITION BY c) - g) / (SUM(h) OVER (PARTITION BY c) - h + 1e-3) AS shift FROM g)
SELECT c AS category, ROUND(SQRT(VAR_POP(shift) * COUNT(*) * 7 / 8), 3) AS stderr FROM s GROUP BY 1""")
def _(spark, sf):
    """Standard errors of one feature's scores in the model's lookup table: a jackknife over eight bags of rows."""
    from glasswork.sources.store import extract_lookup

    rows = table(spark, sf, "orders")
    model = fit_additive(rows, "o_totalprice", ["o_orderpriority"], "regression", keys=["o_orderkey"])
    out = extract_lookup(spark, model).filter("category IS NOT NULL")
    return out.select("category", F.round(F.col("stderr")[0], 3).alias("stderr"))


# Two features: the least squares solution by Cramer's rule.
OLS_SQL = """(WITH m AS (SELECT VAR_POP(l_quantity) AS vq, VAR_POP(l_discount) AS vd, COVAR_POP(l_quantity, l_discount) AS cqd,
  COVAR_POP(l_quantity, l_extendedprice) AS cq, COVAR_POP(l_discount, l_extendedprice) AS cd, AVG(l_quantity) AS aq,
  AVG(l_discount) AS ad, AVG(l_extendedprice) AS ay FROM lineitem),
b AS (SELECT *, (cq * vd - cd * cqd) / (vq * vd - cqd * cqd) AS bq, (cd * vq - cq * cqd) / (vq * vd - cqd * cqd) AS bd FROM m)
SELECT bq, bd, ay - bq * aq - bd * ad AS b0 FROM b)"""


@query("linear_regression", f"""
SELECT l_orderkey, l_linenumber, l_partkey, ROUND(b0 + bq * l_quantity + bd * l_discount, 3) AS prediction FROM lineitem, {OLS_SQL}""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem")
    model = fit_linear(rows, "l_extendedprice", ["l_quantity", "l_discount"], alpha=0.0)
    out = predict(rows, model).select("l_orderkey", "l_linenumber", "l_partkey", "prediction")
    return rounded(out, "prediction", digits=3)


@query("lasso_regression", """
WITH m AS (SELECT COVAR_POP(o_custkey, o_totalprice) AS c, VAR_POP(o_custkey) AS v, AVG(o_custkey) AS ax, AVG(o_totalprice) AS ay FROM orders),
b AS (SELECT *, SIGN(c) * GREATEST(ABS(c) - 1000, 0) / v AS b FROM m)
SELECT o_orderkey, ROUND(ay + b * (o_custkey - ax), 2) AS prediction FROM orders, b""")
def _(spark, sf):
    rows = table(spark, sf, "orders")
    model = fit_linear(rows, "o_totalprice", ["o_custkey"], alpha=1000.0)
    return rounded(predict(rows, model).select("o_orderkey", "prediction"), "prediction", digits=2)


@query("logistic_binary", """
SELECT l_linestatus, ROUND(AVG(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 4)::DOUBLE AS probability FROM lineitem GROUP BY 1""")
def _(spark, sf):
    """One 0/1 feature and hardly any penalty: the shares of positives."""
    rows = step_rows(spark, sf).withColumn("open", (F.col("l_linestatus") == "O").cast("int"))
    model = fit_logistic(rows, "y", ["open"], C=1e9)
    return rounded(predict(rows, model).select("l_linestatus", "probability").distinct(), "probability", digits=4)


@query("logistic_multinomial", """
SELECT l_linestatus, ROUND(AVG((l_returnflag = 'A')::INTEGER), 3)::DOUBLE AS "probability_A",
  ROUND(AVG((l_returnflag = 'N')::INTEGER), 3)::DOUBLE AS "probability_N",
  ROUND(AVG((l_returnflag = 'R')::INTEGER), 3)::DOUBLE AS "probability_R" FROM lineitem GROUP BY 1""")
def _(spark, sf):
    rows = step_rows(spark, sf).withColumn("open", (F.col("l_linestatus") == "O").cast("int"))
    model = fit_logistic(rows, "l_returnflag", ["open"], C=1e9)
    probs = probability_columns(model)
    return rounded(predict(rows, model).select("l_linestatus", *probs).distinct(), *probs, digits=3)


@query("decision_tree_regression", """
SELECT l_discount, ROUND(AVG(l_extendedprice), 3) AS prediction FROM lineitem GROUP BY 1""")
def _(spark, sf):
    """One feature of eleven values and depth to spare: the mean per value."""
    rows = table(spark, sf, "lineitem")
    model = fit_tree(rows, "l_extendedprice", ["l_discount"], "regression", max_depth=10)
    return rounded(predict(rows, model).select("l_discount", "prediction").distinct(), "prediction", digits=3)


@query("decision_tree_classification", """
SELECT l_tax, ARG_MAX(l_returnflag, n) AS prediction FROM (
  SELECT l_tax, l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem")
    model = fit_tree(rows, "l_returnflag", ["l_tax"], "multiclass", max_depth=10)
    return predict(rows, model).select("l_tax", "prediction").distinct()


FOLD = "('0x' || SUBSTR(MD5('42|' || o_orderkey), 1, 8))::BIGINT % 5"


@query("cross_fit", f"""
WITH o AS (SELECT o_orderkey, o_custkey AS x, o_totalprice AS y, {FOLD} AS fold FROM orders),
b AS (SELECT k, REGR_SLOPE(y, x) AS s, REGR_INTERCEPT(y, x) AS i FROM o, range(5) AS r(k) WHERE fold <> k GROUP BY k)
SELECT o_orderkey, ROUND(i + s * x, 2) AS prediction FROM o JOIN b ON k = fold""")
def _(spark, sf):
    rows = kfold(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])
    out = cross_fit(rows, lambda train: (fit_linear(train, "o_totalprice", ["o_custkey"], alpha=0.0), None))
    return rounded(out.select("o_orderkey", "prediction"), "prediction", digits=2)


@query("cross_fit_linear", f"""
WITH o AS (SELECT o_orderkey, o_custkey AS x, o_totalprice AS y, {FOLD} AS fold FROM orders),
b AS (SELECT k, SIGN(c) * GREATEST(ABS(c) - 500, 0) / v AS s, ax, ay FROM (SELECT k, COVAR_POP(y, x) AS c, VAR_POP(x) AS v, AVG(x) AS ax, AVG(y) AS ay
  FROM o, range(5) AS r(k) WHERE fold <> k GROUP BY k))
SELECT o_orderkey, ROUND(ay + s * (x - ax), 2) AS prediction FROM o JOIN b ON k = fold""")
def _(spark, sf):
    """All folds of a penalised fit from one scan of products, predictions from a second one."""
    rows = kfold(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])
    _, out = cross_fit_linear(rows, "o_totalprice", ["o_custkey"], alpha=500.0)
    return rounded(out.select("o_orderkey", "prediction"), "prediction", digits=2)


@query("predict", """
SELECT l_orderkey, l_linenumber, l_partkey, ROUND(1250.5 + 2047.25 * l_quantity - 815.5 * l_discount, 4) AS prediction FROM lineitem""")
def _(spark, sf):
    out = predict(table(spark, sf, "lineitem"), LINEAR)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "prediction"), "prediction", digits=4)


@query("platt_calibrate", """
SELECT l_linestatus, ROUND(AVG(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 4)::DOUBLE AS calibrated FROM lineitem GROUP BY 1""")
def _(spark, sf):
    """Two distinct scores: the two coefficients reproduce both shares."""
    rows = step_rows(spark, sf).withColumn("p", F.when(F.col("l_linestatus") == "F", 0.9).otherwise(0.2))
    fit = cal.platt_calibrate(rows, C=1e9)
    return rows.select("l_linestatus", F.round(fit.column("p"), 4).alias("calibrated")).distinct()


# The max-min formula of monotone regression.
ISOTONIC_SQL = f"""
WITH d AS (SELECT p, COUNT(*) AS n, SUM(y) AS s FROM {SCORED_SQL} GROUP BY p),
c AS (SELECT p, n, s, SUM(n) OVER (ORDER BY p) AS cn, SUM(s) OVER (ORDER BY p) AS cs FROM d),
m AS (SELECT i.p, a.p AS ap, MIN((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) AS low
  FROM c AS i JOIN c AS a ON a.p <= i.p JOIN c AS b ON b.p >= i.p GROUP BY 1, 2)
SELECT p, ROUND(MAX(low), 6)::DOUBLE AS calibrated FROM m GROUP BY p"""


@query("isotonic_calibrate", ISOTONIC_SQL)
def _(spark, sf):
    rows = scored(spark, sf)
    fit = cal.isotonic_calibrate(rows)
    return rows.select("p").distinct().select("p", r6(fit.column("p")).alias("calibrated"))


@query("isotonic_distinct_scores", """
WITH s AS (SELECT c_acctbal AS p, AVG((c_mktsegment = 'BUILDING' OR c_nationkey * 437 < c_acctbal)::INTEGER) * COUNT(*) AS s, COUNT(*) AS n
  FROM customer GROUP BY 1),
c AS (SELECT p, n, s, SUM(n) OVER (ORDER BY p) AS cn, SUM(s) OVER (ORDER BY p) AS cs FROM s),
m AS (SELECT a.p AS ap, b.p, MIN((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) OVER (
  PARTITION BY a.p ORDER BY b.p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low
  FROM c AS a JOIN c AS b ON b.p >= a.p)
SELECT p, ROUND(MAX(low), 6)::DOUBLE AS calibrated FROM m GROUP BY p""")
def _(spark, sf):
    """About as many distinct scores as rows, and a curve of many knots."""
    rows = table(spark, sf, "customer").select(
        F.col("c_acctbal").alias("p"), ((F.col("c_mktsegment") == "BUILDING") | (F.col("c_nationkey") * 437 < F.col("c_acctbal"))).cast("int").alias("y"))
    fit = cal.isotonic_calibrate(rows, tolerance=0.0)
    return rows.select("p").distinct().select("p", r6(fit.column("p")).alias("calibrated"))


@query("calibrate_auto", ISOTONIC_SQL)
def _(spark, sf):
    """More than a thousand rows: the automatic choice is the isotonic one."""
    rows = scored(spark, sf)
    fit = cal.calibrate(rows)
    return rows.select("p").distinct().select("p", r6(fit.column("p")).alias("calibrated"))
