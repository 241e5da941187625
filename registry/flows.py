"""End-to-end flow queries."""

from pyspark.sql import functions as F

from glasswork.plans import flows
from glasswork.plans.options import Options
from registry.common import BINARY, LINEAR, Registry, r6, rounded, table
from registry.evaluation import DIGITS, METRIC_SQL, PRED_SQL, THRESHOLD_SQL

REG = Registry()
query = REG.query

ORDER_HASH = "MD5('42|' || o_orderkey)"


@query("build_folds", f"""
WITH p AS (SELECT o_orderkey, o_orderstatus, ROW_NUMBER() OVER (ORDER BY o_orderdate DESC, {ORDER_HASH} DESC) AS late FROM orders)
SELECT o_orderkey, late <= 500 AS is_oot, CASE WHEN late > 500 THEN (ROW_NUMBER() OVER (
  PARTITION BY late <= 500, o_orderstatus ORDER BY {ORDER_HASH}) - 1) % 5 END::INTEGER AS fold FROM p""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    options = Options.from_config({"target": "o_orderstatus", "pre_params": {
        "oot_set": True, "oot_rows": 500, "time_sensitive_column": "o_orderdate"}}, orders.columns)
    return flows.build_folds(orders, options, ["o_orderkey"], "classification").select("o_orderkey", "is_oot", "fold")


def _summary(result, names):
    parts = []
    for name in names:
        t = result.tables[name]
        value = "auc" if "auc" in t.columns else "brier" if "brier" in t.columns else "value"
        metric = F.col("metric") if "metric" in t.columns else F.lit(name)
        parts.append(t.select("data_type", metric.alias("metric"), r6(value).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("run_documents")
def _(spark, sf):
    """Document quality from length, language and source, by an additive model."""
    rows = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    config = {"target": "quality", "features": ["n_chars", "lang", "source"],
              "model_params": {"max_bins": 16, "rounds": 50, "bags": 1, "passes": 3}}
    return _summary(flows.run(rows, config, "ebm", ["doc_id"]), ["roc_auc", "pr_auc", "brier"])


@query("run_binary", f"""
WITH o AS (SELECT o_orderkey, o_orderpriority AS c, (o_orderstatus = 'F')::INTEGER AS y FROM orders),
f AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY y ORDER BY {ORDER_HASH}) - 1) % 5 AS fold FROM o),
t AS (SELECT c, AVG(y) AS p FROM o GROUP BY c),
v AS (SELECT k, c, AVG(y) AS p FROM f, range(5) AS r(k) WHERE fold <> k GROUP BY k, c)
SELECT 'train' AS data_type, ROUND(AVG(POW(y - p, 2)), 5)::DOUBLE AS brier FROM o JOIN t USING (c)
UNION ALL SELECT 'test', ROUND(AVG(POW(y - p, 2)), 5)::DOUBLE FROM f JOIN v ON v.c = f.c AND k = fold""")
def _(spark, sf):
    """The whole flow on one categorical feature, whose fitted probabilities are the shares in the training folds."""
    rows = table(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    config = {"target": "y", "features": ["o_orderpriority"], "model_params": {"rounds": 500, "bags": 1}}
    result = flows.run(rows, config, "ebm", ["o_orderkey"])
    return rounded(result.tables["brier"], "brier", digits=5)


@query("run_regression", f"""
WITH f AS (SELECT o_custkey AS x, o_totalprice AS y, ('0x' || SUBSTR({ORDER_HASH}, 1, 8))::BIGINT % 5 AS fold FROM orders),
b AS (SELECT k, REGR_SLOPE(y, x) AS s, REGR_INTERCEPT(y, x) AS i FROM f, range(-1, 5) AS r(k) WHERE fold <> k GROUP BY k),
e AS (SELECT CASE WHEN k < 0 THEN 'train' ELSE 'test' END AS data_type, i + s * x - y AS e FROM f JOIN b ON k = fold OR k < 0)
SELECT data_type, 'mae' AS metric, ROUND(AVG(ABS(e)), 2) AS value FROM e GROUP BY 1
UNION ALL SELECT data_type, 'max_error', ROUND(MAX(ABS(e)), 2) FROM e GROUP BY 1
UNION ALL SELECT data_type, 'median_ae', ROUND(quantile_cont(ABS(e), 0.5), 2) FROM e GROUP BY 1""")
def _(spark, sf):
    """The whole flow with least squares on one feature."""
    config = {"target": "o_totalprice", "features": ["o_custkey"], "model_params": {"alpha": 0.0}}
    result = flows.run(table(spark, sf, "orders"), config, "l_regression", ["o_orderkey"])
    out = result.tables["regression_metrics"].filter(F.col("metric").isin("mae", "max_error", "median_ae"))
    return rounded(out, "value", digits=2)


def _coarse(metric):
    """Digits that two orders of summation agree on."""
    return -2 if metric == "mse" else min(DIGITS.get(metric, 5), 2 if metric in DIGITS else 5)


def _by_metric(df):
    """Each metric rounded to its digits."""
    value = F.round("value", 5)
    for m in METRIC_SQL:
        value = F.when(F.col("metric") == m, F.round("value", _coarse(m))).otherwise(value)
    return df.withColumn("value", value)


@query("run_regression_metrics", f"""
WITH f AS (SELECT o_custkey AS x, o_totalprice AS y, ('0x' || SUBSTR({ORDER_HASH}, 1, 8))::BIGINT % 5 AS fold FROM orders),
b AS (SELECT k, REGR_SLOPE(y, x) AS s, REGR_INTERCEPT(y, x) AS i FROM f, range(-1, 5) AS r(k) WHERE fold <> k GROUP BY k),
p AS (SELECT CASE WHEN k < 0 THEN 'train' ELSE 'test' END AS data_type, i + s * x AS h, i + s * x - y AS e, y FROM f JOIN b ON k = fold OR k < 0)
""" + " UNION ALL ".join(
    f"SELECT data_type, '{m}' AS metric, ROUND({q.replace('- 2 - 1', '- 1 - 1')}, {_coarse(m)}) AS value FROM p GROUP BY 1" for m, q in METRIC_SQL.items()))
def _(spark, sf):
    """The whole flow with least squares on one feature: every metric of both parts."""
    config = {"target": "o_totalprice", "features": ["o_custkey"], "model_params": {"alpha": 0.0}}
    return _by_metric(flows.run(table(spark, sf, "orders"), config, "l_regression", ["o_orderkey"]).tables["regression_metrics"])


@query("check_model_regression_metrics", " UNION ALL ".join(
    f"SELECT 'test' AS data_type, '{m}' AS metric, ROUND({q}, {_coarse(m)}) AS value FROM {PRED_SQL}" for m, q in METRIC_SQL.items()))
def _(spark, sf):
    """Every metric of a stored model on a new table."""
    tables, _ = flows.check_model(LINEAR, table(spark, sf, "lineitem"), ["l_orderkey"])
    return _by_metric(tables["regression_metrics"])


@query("run_fold_means", f"""
WITH o AS (SELECT o_orderkey, o_orderpriority AS c, (o_orderstatus = 'F')::INTEGER AS y FROM orders),
f AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY y ORDER BY {ORDER_HASH}) - 1) % 5 AS fold FROM o),
v AS (SELECT k, c, AVG(y) AS p FROM f, range(5) AS r(k) WHERE fold <> k GROUP BY k, c),
s AS (SELECT fold, y, p FROM f JOIN v ON v.c = f.c AND k = fold),
d AS (SELECT fold, p, SUM(y) AS pos, COUNT(*) - SUM(y) AS neg FROM s GROUP BY 1, 2),
a AS (SELECT fold, SUM(neg * (SELECT COALESCE(SUM(pos), 0) FROM d AS h WHERE h.fold = d.fold AND h.p > d.p) + neg * pos / 2) / (SUM(pos) * SUM(neg)) AS auc
  FROM d GROUP BY 1)
SELECT 'test' AS data_type, ROUND(AVG(auc), 4)::DOUBLE AS mean_roc_auc, (SELECT ROUND(AVG(b), 5)::DOUBLE FROM (
  SELECT AVG(POW(y - p, 2)) AS b FROM s GROUP BY fold)) AS mean_brier FROM a""")
def _(spark, sf):
    """The whole flow on one categorical feature: means over the folds of what each held-out fold scores."""
    rows = table(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    config = {"target": "y", "features": ["o_orderpriority"], "model_params": {"max_rounds": 500, "outer_bags": 1}}
    means = flows.run(rows, config, "ebm", ["o_orderkey"]).tables["fold_means"]
    return means.select("data_type", F.round("mean_roc_auc", 4).alias("mean_roc_auc"), F.round("mean_brier", 5).alias("mean_brier"))


@query("run_multiclass_tree")
def _(spark, sf):
    rows = table(spark, sf, "orders").withColumn("month", F.month("o_orderdate"))
    config = {"target": "o_orderstatus", "features": ["o_totalprice", "o_custkey", "month"],
              "model_params": {"max_depth": 4}}
    result = flows.run(rows, config, "decision_tree", ["o_orderkey"])
    return result.tables["confusion_matrix"]


@query("check_model_binary", f"SELECT 'test' AS data_type, threshold, actual, predicted, n, ROUND(share, 6) AS share FROM ({THRESHOLD_SQL})")
def _(spark, sf):
    """Evaluate a stored model on a new table."""
    rows = table(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    tables, _ = flows.check_model(BINARY, rows, ["l_orderkey", "l_linenumber"])
    return rounded(tables["confusion_by_threshold"], "share")


@query("check_model_regression", f"""
SELECT 'test' AS data_type, 'mae' AS metric, ROUND(AVG(ABS(e)), 3) AS value FROM {PRED_SQL}
UNION ALL SELECT 'test', 'max_error', ROUND(MAX(ABS(e)), 3) FROM {PRED_SQL}""")
def _(spark, sf):
    tables, _ = flows.check_model(LINEAR, table(spark, sf, "lineitem"), ["l_orderkey"])
    out = tables["regression_metrics"].filter(F.col("metric").isin("mae", "max_error"))
    return rounded(out, "value", digits=3)
