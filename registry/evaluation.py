"""Evaluation queries over lineitem scored with the fixed models."""

from pyspark.sql import functions as F

from glasswork.operators import evaluate as ops
from glasswork.operators.score import predict, probability_columns
from registry.common import FLAGS, LINEAR, MULTI, SCORED_SQL, TREE, Registry, r6, rounded, scored, table

REG = Registry()
query = REG.query

PRED_SQL = """(SELECT l_extendedprice AS y, 1250.5 + 2047.25 * l_quantity - 815.5 * l_discount AS h,
  1250.5 + 2047.25 * l_quantity - 815.5 * l_discount - l_extendedprice AS e, l_returnflag FROM lineitem)"""


def predicted(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_extendedprice", "l_returnflag")
    return predict(li, LINEAR).withColumnRenamed("l_extendedprice", "y")


@query("confusion_matrix", """
SELECT l_returnflag AS actual, CASE WHEN l_quantity <= 24.5 AND l_discount <= 0.045 THEN 'A' ELSE 'N' END AS predicted,
  COUNT(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    return ops.confusion_matrix(predict(table(spark, sf, "lineitem"), TREE), "l_returnflag")


THRESHOLD_SQL = f"""
SELECT ROUND(k * 5E-2, 2) AS threshold, y AS actual, c AS predicted,
  COUNT(*) FILTER (CASE WHEN p > k * 5E-2 THEN 1 ELSE 0 END = c) AS n,
  COUNT(*) FILTER (CASE WHEN p > k * 5E-2 THEN 1 ELSE 0 END = c) / (SELECT COUNT(*) FROM lineitem) AS share
FROM {SCORED_SQL}, range(21) AS r(k), (VALUES (0), (1)) AS v(c) GROUP BY k, y, c"""


@query("confusion_by_threshold", f"SELECT threshold, actual, predicted, n, ROUND(share, 6) AS share FROM ({THRESHOLD_SQL})")
def _(spark, sf):
    return rounded(ops.confusion_by_threshold(scored(spark, sf)), "share")


REPORT_SQL = """, sides AS (
  SELECT g, actual::VARCHAR AS label, CASE WHEN actual = predicted THEN n ELSE 0 END AS hit, n AS support, 0 AS named FROM c
  UNION ALL SELECT g, predicted::VARCHAR, 0, 0, n FROM c),
per AS (SELECT g, label, SUM(hit) AS hit, SUM(support) AS support,
    CASE WHEN SUM(named) = 0 THEN 0 ELSE SUM(hit) / SUM(named) END AS pr,
    CASE WHEN SUM(support) = 0 THEN 0 ELSE SUM(hit) / SUM(support) END AS rc
  FROM sides GROUP BY g, label HAVING SUM(support) + SUM(named) > 0),
f AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS fs FROM per),
allrows AS (SELECT g, label, pr, rc, fs, support FROM f
  UNION ALL SELECT g, 'accuracy', NULL, NULL, SUM(hit) / SUM(support), NULL FROM f GROUP BY g
  UNION ALL SELECT g, 'macro avg', AVG(pr), AVG(rc), AVG(fs), SUM(support) FROM f GROUP BY g
  UNION ALL SELECT g, 'weighted avg', SUM(pr * support) / SUM(support), SUM(rc * support) / SUM(support),
    SUM(fs * support) / SUM(support), SUM(support) FROM f GROUP BY g)"""
REPORT_COLS = """label, ROUND(pr, 6)::DOUBLE AS "precision", ROUND(rc, 6)::DOUBLE AS recall, ROUND(fs, 6)::DOUBLE AS f1,
  support::BIGINT AS support FROM allrows"""


@query("classification_report", f"""WITH c AS (SELECT threshold AS g, actual, predicted, n FROM ({THRESHOLD_SQL}))
{REPORT_SQL} SELECT g AS threshold, {REPORT_COLS}""")
def _(spark, sf):
    counts = ops.confusion_by_threshold(scored(spark, sf))
    return rounded(ops.classification_report(counts, ["threshold"]), "precision", "recall", "f1")


@query("classification_report_multiclass", f"""WITH c AS (SELECT 0 AS g, l_returnflag AS actual, CASE WHEN l_quantity <= 24.5
  AND l_discount <= 0.045 THEN 'A' ELSE 'N' END AS predicted, COUNT(*) AS n FROM lineitem GROUP BY 1, 2, 3)
{REPORT_SQL} SELECT {REPORT_COLS}""")
def _(spark, sf):
    counts = ops.confusion_matrix(predict(table(spark, sf, "lineitem"), TREE), "l_returnflag")
    return rounded(ops.classification_report(counts), "precision", "recall", "f1")


def curve_sql(rows=SCORED_SQL, g="0"):
    """Cumulative counts per distinct score in descending order, as table ``cum``."""
    return f"""WITH d AS (SELECT {g} AS g, p, COUNT(*) AS n, SUM(y) AS pos FROM {rows} GROUP BY 1, 2),
cum AS (SELECT g, p, n, pos, SUM(n) OVER w AS above, SUM(pos) OVER w AS tp, SUM(pos) OVER (PARTITION BY g) AS np,
  SUM(n) OVER (PARTITION BY g) AS nn, LEAD(n) OVER w AS next_n, LEAD(pos) OVER w AS next_pos,
  ROW_NUMBER() OVER w AS i FROM d WINDOW w AS (PARTITION BY g ORDER BY p DESC))"""


def roc_sql(rows=SCORED_SQL, g="0", name=None):
    lead = f"g AS {name}, " if name else ""
    return curve_sql(rows, g) + f"""
SELECT {lead}p AS threshold, ROUND((above - tp) / (nn - np), 6)::DOUBLE AS fpr, ROUND(tp / np, 6)::DOUBLE AS tpr FROM cum
WHERE i = 1 OR next_n IS NULL OR next_n <> n OR next_pos <> pos
UNION ALL SELECT {lead}NULL, 0E0, 0E0 FROM cum WHERE i = 1"""


def pr_sql(rows=SCORED_SQL, g="0", name=None):
    lead = f"g AS {name}, " if name else ""
    return curve_sql(rows, g) + f"""
SELECT {lead}p AS threshold, ROUND(tp / above, 6)::DOUBLE AS "precision", ROUND(tp / np, 6)::DOUBLE AS recall,
  ROUND(np / nn, 6)::DOUBLE AS baseline FROM cum
UNION ALL SELECT {lead}NULL, 1E0, 0E0, ROUND(np / nn, 6)::DOUBLE FROM cum WHERE i = 1"""


def roc_auc_sql(rows=SCORED_SQL, g="0", name=None):
    lead = f"g AS {name}, " if name else ""
    return curve_sql(rows, g) + f"""
SELECT {lead}ROUND(SUM((n - pos)::DOUBLE * (tp + tp - pos) / 2) / ANY_VALUE(np::DOUBLE * (nn - np)), 6)::DOUBLE AS auc
FROM cum {"GROUP BY g" if name else ""}"""


def pr_auc_sql(rows=SCORED_SQL, g="0", name=None):
    lead = f"g AS {name}, " if name else ""
    return curve_sql(rows, g) + f"""
SELECT {lead}ROUND(SUM((pos / np) * (tp / above + CASE WHEN i = 1 THEN 1 ELSE (tp - pos) / (above - n) END) / 2), 6)::DOUBLE
  AS auc FROM cum {"GROUP BY g" if name else ""}"""


MIRROR_SQL = f"(SELECT 1 - y AS y, 1E0 - p AS p, fold FROM {SCORED_SQL})"


@query("roc_curve", roc_sql())
def _(spark, sf):
    return rounded(ops.roc_curve(scored(spark, sf)), "fpr", "tpr")


@query("roc_curve_by_fold", roc_sql(g="fold", name="fold"))
def _(spark, sf):
    return rounded(ops.roc_curve(scored(spark, sf), by=["fold"]), "fpr", "tpr")


@query("roc_auc", roc_auc_sql())
def _(spark, sf):
    return rounded(ops.roc_auc(scored(spark, sf)), "auc")


@query("pr_curve", pr_sql())
def _(spark, sf):
    return rounded(ops.pr_curve(scored(spark, sf)), "precision", "recall", "baseline")


@query("pr_auc", pr_auc_sql())
def _(spark, sf):
    return rounded(ops.pr_auc(scored(spark, sf)), "auc")


@query("pr_curve_class_0", pr_sql(MIRROR_SQL))
def _(spark, sf):
    return rounded(ops.pr_curve(ops.mirror(scored(spark, sf))), "precision", "recall", "baseline")


@query("fold_mean_auc", f"SELECT ROUND(AVG(auc), 5) AS mean_auc FROM ({roc_auc_sql(g='fold', name='fold')})")
def _(spark, sf):
    return rounded(ops.fold_mean(ops.roc_auc(scored(spark, sf), by=["fold"])), "mean_auc", digits=5)


STRETCHES_SQL = f"""WITH c AS (SELECT fold, p, COUNT(*) AS n, SUM(y) AS pos FROM {SCORED_SQL} GROUP BY 1, 2),
t AS (SELECT fold, SUM(n - pos) AS negatives, SUM(pos) AS positives FROM c GROUP BY 1),
s AS (SELECT fold, p, n, pos, SUM(n) OVER w AS above, SUM(pos) OVER w AS tp, SUM(n - pos) OVER w AS fp FROM c
  WINDOW w AS (PARTITION BY fold ORDER BY p DESC)),
g AS (SELECT UNNEST(range(0, 101)) AS i)"""
MEAN_SQL = """SELECT i / 100 AS x, ROUND(AVG(v), 6)::DOUBLE AS mean, ROUND(MIN(v), 6)::DOUBLE AS low, ROUND(MAX(v), 6)::DOUBLE AS high,
  COUNT(*) AS folds FROM v GROUP BY i"""


@query("mean_roc_curve", f"""{STRETCHES_SQL},
v AS (SELECT fold, i, MAX(CASE WHEN n = pos THEN tp ELSE tp - pos + (i * negatives / 100 - (fp - n + pos)) / (n - pos) * pos END / positives) AS v
  FROM s JOIN t USING (fold) JOIN g ON i * negatives BETWEEN 100 * (fp - n + pos) AND 100 * fp GROUP BY 1, 2)
{MEAN_SQL}""")
def _(spark, sf):
    return rounded(ops.mean_curve(scored(spark, sf), "roc"), "mean", "low", "high")


@query("mean_pr_curve", f"""{STRETCHES_SQL},
v AS (SELECT fold, i, CASE WHEN i = 0 THEN 1E0 ELSE ARG_MAX(tp / above, p) END AS v
  FROM s JOIN t USING (fold) JOIN g ON i * positives BETWEEN 100 * (tp - pos) AND 100 * tp GROUP BY 1, 2)
{MEAN_SQL}""")
def _(spark, sf):
    return rounded(ops.mean_curve(scored(spark, sf), "pr"), "mean", "low", "high")


@query("fold_scores", f"""SELECT fold, ROUND(auc, 5) AS roc_auc, ROUND(pr.area, 5)::DOUBLE AS pr_auc, ROUND(b.brier, 5) AS brier
FROM ({roc_auc_sql(g='fold', name='fold')}) AS roc JOIN (
  WITH c AS (SELECT fold, p, COUNT(*) AS n, SUM(y) AS pos FROM {SCORED_SQL} GROUP BY 1, 2),
  s AS (SELECT fold, pos, SUM(n) OVER w AS above, SUM(pos) OVER w AS tp, n FROM c WINDOW w AS (PARTITION BY fold ORDER BY p DESC))
  SELECT fold, SUM(pos * (tp / above + COALESCE((tp - pos) / NULLIF(above - n, 0), 1)) / 2) / SUM(pos) AS area FROM s GROUP BY 1) AS pr USING (fold)
JOIN (SELECT fold, AVG((p - y) * (p - y)) AS brier FROM {SCORED_SQL} GROUP BY 1) AS b USING (fold)""")
def _(spark, sf):
    return rounded(ops.fold_scores(scored(spark, sf)), "roc_auc", "pr_auc", "brier", digits=5)


def calibration_sql(rows=SCORED_SQL, g="0", name=None):
    lead = f"g AS {name}, " if name else ""
    return f"""WITH s AS (SELECT {g} AS g, y, p FROM {rows}),
e AS (SELECT g, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM s GROUP BY g),
b AS (SELECT s.g, y, p, LEN(LIST_FILTER(edges, lambda x: x < p))::INTEGER AS bin FROM s JOIN e USING (g))
SELECT {lead}bin, COUNT(*) AS n, ROUND(AVG(p), 6) AS mean_predicted, ROUND(AVG(y), 6) AS fraction_positive
FROM b GROUP BY {'g, ' if name else ''}bin"""


@query("calibration_curve", calibration_sql())
def _(spark, sf):
    return rounded(ops.calibration_curve(scored(spark, sf)), "mean_predicted", "fraction_positive")


@query("calibration_curve_sketch", calibration_sql(g="fold", name="fold").replace("quantile_cont", "quantile_disc"))
def _(spark, sf):
    """Edges from sketches that are large enough to be exact here."""
    return rounded(ops.calibration_curve(scored(spark, sf), by=["fold"], accuracy=10_000_000), "mean_predicted", "fraction_positive")


@query("calibration_curve_by_fold", calibration_sql(g="fold", name="fold"))
def _(spark, sf):
    return rounded(ops.calibration_curve(scored(spark, sf), by=["fold"]), "mean_predicted", "fraction_positive")


@query("brier_score", f"SELECT ROUND(AVG((p - y) * (p - y)), 6) AS brier FROM {SCORED_SQL}")
def _(spark, sf):
    return rounded(ops.brier(scored(spark, sf)), "brier")


MULTI_P_SQL = """(WITH s AS (SELECT l_returnflag AS label,
  0E0 - 0.2 + CASE WHEN l_quantity <= 15 THEN 0.2 WHEN l_quantity <= 35 THEN 0.0 ELSE -0.3 END
    + CASE l_linestatus WHEN 'F' THEN 0.4 ELSE -0.45 END AS a,
  0.3 + 0E0 + CASE WHEN l_quantity <= 15 THEN -0.1 WHEN l_quantity <= 35 THEN 0.15 ELSE 0.1 END
    + CASE l_linestatus WHEN 'F' THEN -0.6 ELSE 0.5 END AS n,
  0E0 - 0.1 + CASE WHEN l_quantity <= 15 THEN 0.05 WHEN l_quantity <= 35 THEN -0.05 ELSE 0.25 END
    + CASE l_linestatus WHEN 'F' THEN 0.35 ELSE -0.4 END AS r FROM lineitem),
e AS (SELECT label, EXP(a) AS a, EXP(n) AS n, EXP(r) AS r FROM s)
SELECT class, CASE WHEN label = class THEN 1 ELSE 0 END AS y, ROUND(v / (a + n + r), 6) AS p
FROM (SELECT *, UNNEST(['A', 'N', 'R']) AS class, UNNEST([a, n, r]) AS v FROM e))"""


def rest_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_linestatus", "l_returnflag")
    probs = probability_columns(MULTI)
    out = rounded(predict(li, MULTI), *probs).select("l_returnflag", *probs)
    return ops.one_vs_rest(out, "l_returnflag", dict(zip(FLAGS, probs)))


@query("one_vs_rest_auc", roc_auc_sql(MULTI_P_SQL, "class", "class"))
def _(spark, sf):
    return rounded(ops.roc_auc(rest_rows(spark, sf), by=["class"]), "auc")


@query("one_vs_rest_pr_curve", pr_sql(MULTI_P_SQL, "class", "class"))
def _(spark, sf):
    return rounded(ops.pr_curve(rest_rows(spark, sf), by=["class"]), "precision", "recall", "baseline")


@query("one_vs_rest_calibration", calibration_sql(MULTI_P_SQL, "class", "class"))
def _(spark, sf):
    return rounded(ops.calibration_curve(rest_rows(spark, sf), by=["class"]), "mean_predicted", "fraction_positive")


@query("probability_histogram", f"""
SELECT y, LEAST(FLOOR(p / 0.01E0), 99)::BIGINT AS bin, COUNT(*) AS n,
  ROUND(COUNT(*) / (SUM(COUNT(*)) OVER (PARTITION BY y) * 0.01E0), 6) AS density FROM {SCORED_SQL} GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(ops.probability_histogram(scored(spark, sf)), "density")


@query("density_histogram", """
WITH m AS (SELECT MIN(l_extendedprice) AS lo, (MAX(l_extendedprice) - MIN(l_extendedprice)) / 50E0 AS w FROM lineitem)
SELECT l_returnflag, LEAST(FLOOR((l_extendedprice - lo) / w), 49)::BIGINT AS bin, COUNT(*) AS n,
  ROUND(COUNT(*) / (SUM(COUNT(*)) OVER (PARTITION BY l_returnflag) * ANY_VALUE(w)), 8) AS density
FROM lineitem, m GROUP BY 1, 2""")
def _(spark, sf):
    out = ops.density_histogram(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")
    return rounded(out, "density", digits=8)


@query("group_distribution", """
SELECT l_returnflag, COUNT(*) AS n, ROUND(AVG(l_extendedprice), 4) AS mean, MIN(l_extendedprice) AS min,
  MAX(l_extendedprice) AS max, ROUND(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
  ROUND(quantile_cont(l_extendedprice, 0.5), 6) AS median, ROUND(quantile_cont(l_extendedprice, 0.75), 6) AS q3
FROM lineitem GROUP BY 1""")
def _(spark, sf):
    out = ops.group_distribution(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")
    return rounded(rounded(out, "q1", "median", "q3"), "mean", digits=4)


@query("prediction_pairs", f"SELECT y AS actual, ROUND(h, 4) AS predicted FROM {PRED_SQL}")
def _(spark, sf):
    return rounded(ops.prediction_pairs(predicted(spark, sf)), "predicted", digits=4)


@query("prediction_pairs_binned", f"""
WITH q AS (SELECT o_totalprice AS y, o_totalprice * 0.5E0 + o_custkey AS h FROM orders),
m AS (SELECT MIN(y) AS ly, (MAX(y) - MIN(y)) / 100E0 AS wy, MIN(h) AS lh, (MAX(h) - MIN(h)) / 100E0 AS wh FROM q)
SELECT LEAST(FLOOR((y - ly) / wy), 99)::BIGINT AS actual_bin, LEAST(FLOOR((h - lh) / wh), 99)::BIGINT AS predicted_bin,
  COUNT(*) AS n FROM q, m GROUP BY 1, 2""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * 0.5 + F.col("o_custkey")).alias("prediction"))
    return ops.prediction_pairs(rows, bins=100)


def _box_sql(source: str, group: str = "") -> str:
    """Box table of rows (y, diff), in all or per value of ``group``."""
    first = f"{group}, " if group else ""
    using = f"{group}, bin" if group else "bin"
    by = f"GROUP BY {group}" if group else ""
    match = f"JOIN q USING ({group})" if group else ", q"
    return f"""
WITH s AS (SELECT * FROM {source}),
q AS (SELECT {first}LIST_SORT(LIST_DISTINCT(quantile_cont(y, [i / 20 FOR i IN range(21)]))) AS edges FROM s {by}),
b AS (SELECT {first}diff, GREATEST(LEN(LIST_FILTER(edges, lambda x: x < y)), 1)::INTEGER AS bin, edges FROM s {match}),
x AS (SELECT {first}bin, edges[bin] AS lo, edges[bin + 1] AS hi, quantile_cont(diff, 0.25) AS q1,
  quantile_cont(diff, 0.5) AS median, quantile_cont(diff, 0.75) AS q3 FROM b GROUP BY {first}bin, edges)
SELECT {first}bin, ROUND(lo, 6) AS lo, ROUND(hi, 6) AS hi, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
  COUNT(*) AS n,
  ROUND(MIN(diff) FILTER (diff BETWEEN q1 - 1.5E0 * (q3 - q1) AND q3 + 1.5E0 * (q3 - q1)), 6) AS lower_whisker,
  ROUND(MAX(diff) FILTER (diff BETWEEN q1 - 1.5E0 * (q3 - q1) AND q3 + 1.5E0 * (q3 - q1)), 6) AS upper_whisker,
  COUNT(*) FILTER (NOT diff BETWEEN q1 - 1.5E0 * (q3 - q1) AND q3 + 1.5E0 * (q3 - q1)) AS outliers
FROM b JOIN x USING ({using}) GROUP BY {first}bin, lo, hi, q1, median, q3"""


BOX_COLUMNS = ("lo", "hi", "q1", "median", "q3", "lower_whisker", "upper_whisker")


@query("quantile_error", _box_sql(f"(SELECT y, e AS diff FROM {PRED_SQL})"))
def _(spark, sf):
    return rounded(ops.quantile_error(predicted(spark, sf)), *BOX_COLUMNS)


TYPED_SQL = """(SELECT CASE o_orderstatus WHEN 'O' THEN 'test' ELSE 'train' END AS data_type,
  o_totalprice AS y, o_totalprice * 0.5E0 + o_custkey AS h, o_totalprice * 0.5E0 + o_custkey - o_totalprice AS diff FROM orders)"""


def typed(spark, sf):
    """Orders as rows of an evaluation: in-sample and held-out ones by their status."""
    return table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "O", "test").otherwise("train").alias("data_type"),
        F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * 0.5 + F.col("o_custkey")).alias("prediction"))


@query("evaluate_regression", _box_sql(TYPED_SQL, "data_type"))
def _(spark, sf):
    out = ops.evaluate(typed(spark, sf), "regression", "y")["quantile_error"]
    return rounded(out, *BOX_COLUMNS)


@query("evaluate_regression_pairs", f"""
WITH q AS (SELECT * FROM {TYPED_SQL}),
m AS (SELECT data_type, MIN(y) AS ly, (MAX(y) - MIN(y)) / 100E0 AS wy, MIN(h) AS lh, (MAX(h) - MIN(h)) / 100E0 AS wh FROM q GROUP BY 1)
SELECT data_type, LEAST(FLOOR((y - ly) / wy), 99)::BIGINT AS actual_bin, LEAST(FLOOR((h - lh) / wh), 99)::BIGINT AS predicted_bin,
  COUNT(*) AS n FROM q JOIN m USING (data_type) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return ops.evaluate(typed(spark, sf), "regression", "y")["prediction_pairs"]


METRIC_SQL = {
    "mae": "AVG(ABS(e))",
    "mse": "AVG(e * e)",
    "rmse": "SQRT(AVG(e * e))",
    "r2": "1 - SUM(e * e) / (VAR_POP(y) * COUNT(*))",
    "adj_r2": "1 - (SUM(e * e) / (VAR_POP(y) * COUNT(*))) * (COUNT(*) - 1) / (COUNT(*) - 2 - 1)",
    "mape": "AVG(ABS(e) / GREATEST(ABS(y), 2.220446049250313E-16))",
    "explained_variance": "1 - VAR_POP(e) / VAR_POP(y)",
    "max_error": "MAX(ABS(e))",
    "median_ae": "quantile_cont(ABS(e), 0.5)",
    "msle": "AVG(POW(LN(1 + GREATEST(h, 0)) - LN(1 + GREATEST(y, 0)), 2))",
    "rmsle": "SQRT(AVG(POW(LN(1 + GREATEST(h, 0)) - LN(1 + GREATEST(y, 0)), 2)))",
}
DIGITS = {"mse": 0, "rmse": 3, "mae": 3, "max_error": 3, "median_ae": 3}


def _metric(name):
    digits = DIGITS.get(name, 6)

    @query(name, f"SELECT '{name}' AS metric, ROUND({METRIC_SQL[name]}, {digits}) AS value FROM {PRED_SQL}")
    def _(spark, sf):
        out = ops.regression_metrics(predicted(spark, sf), n_features=2, metrics=[name])
        return rounded(out, "value", digits=digits)


for _name in METRIC_SQL:
    _metric(_name)


@query("regression_metrics", " UNION ALL ".join(
    f"SELECT l_returnflag, '{m}' AS metric, ROUND({s}, {DIGITS.get(m, 6) if m != 'mse' else -1}) AS value "
    f"FROM {PRED_SQL} GROUP BY 1" for m, s in METRIC_SQL.items()))
def _(spark, sf):
    out = ops.regression_metrics(predicted(spark, sf), n_features=2, by=["l_returnflag"])
    value = F.col("value")
    for name, digits in DIGITS.items():
        value = F.when(F.col("metric") == name, F.round("value", digits if name != "mse" else -1)).otherwise(value)
    small = F.col("metric").isin(*DIGITS)
    return out.withColumn("value", F.when(small, value).otherwise(r6("value")))


@query("evaluate_binary", f"""
SELECT 'roc_auc' AS metric, auc AS value FROM ({roc_auc_sql()}) UNION ALL
SELECT 'pr_auc', auc FROM ({pr_auc_sql()}) UNION ALL
SELECT 'pr_auc_class_0', auc FROM ({pr_auc_sql(MIRROR_SQL)}) UNION ALL
SELECT 'brier', ROUND(AVG((p - y) * (p - y)), 6) FROM {SCORED_SQL}""")
def _(spark, sf):
    rows = scored(spark, sf).withColumns({"data_type": F.lit("train"), "prediction": (F.col("p") > 0.5).cast("int")})
    tables = ops.evaluate(rows, "binary", "y", {1: "p"})
    out = None
    for name in ("roc_auc", "pr_auc", "pr_auc_class_0", "brier"):
        value = "brier" if name == "brier" else "auc"
        one = tables[name].select(F.lit(name).alias("metric"), r6(value).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
