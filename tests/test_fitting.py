import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasswork.operators import evaluate as ev
from glasswork.operators.additive import fit_additive
from glasswork.operators.calibrate import Isotonic, Platt, calibrate, isotonic_calibrate
from glasswork.operators.score import predict
from glasswork.operators.tree import fit_tree, gini_importance
from glasswork.plans import flows


@pytest.fixture(scope="module")
def rows(spark):
    """A known additive log-odds, with missing values and a category."""
    u = [F.conv(F.substring(F.md5(F.concat(F.lit(f"{i}|"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
         for i in range(4)]
    df = spark.range(8000).select(
        "id", F.when(F.col("id") % 11 != 0, u[0] * 10).alias("x"), u[1].alias("z"),
        F.when(u[2] < 0.3, "a").when(u[2] < 0.7, "b").otherwise("it's").alias("c"), u[3].alias("draw"))
    logit = F.coalesce(F.when(F.col("x") > 6, 1.5).otherwise(-1.0), F.lit(0.5)) + F.when(F.col("c") == "a", 1.0).otherwise(0.0)
    df = df.withColumn("p", 1 / (1 + F.exp(-logit))).withColumn("y", (F.col("draw") < F.col("p")).cast("int"))
    k = F.when(F.col("draw") < F.col("p") / 2, "low").when(F.col("draw") < F.col("p"), "mid").otherwise("high")
    return df.withColumns({"k": k, "r": logit * 10 + F.col("z")}).drop("draw").cache()


@pytest.mark.parametrize("task,target", [("regression", "r"), ("binary", "y"), ("multiclass", "k")])
def test_loss_falls(rows, task, target):
    history = []
    model = fit_additive(rows, target, ["x", "z", "c"], task, history=history)
    assert all(b <= a + 1e-9 * abs(a) for a, b in zip(history, history[1:]))
    assert history[-1] < history[0]
    assert all(len(t.scores) == len(t.axes[0]) for t in model.terms)
    assert all(s >= 0 for t in model.terms for v in t.stderr.values() for s in v)


def test_binary_recovers_probability(rows):
    model = fit_additive(rows, "y", ["x", "z", "c"], "binary", interactions=1)
    gap = predict(rows, model).agg(F.avg(F.abs(F.col("probability") - F.col("p")))).first()[0]
    assert gap < 0.06 and len(model.terms) == 4


def test_rare_positives_do_not_overshoot(spark):
    """A bin of half positives in a table of 0.5 % positives: plain Newton steps would diverge."""
    df = spark.range(40000).select(
        F.when(F.col("id") < 200, "hot").otherwise("cold").alias("c"), (F.col("id") % 7).cast("double").alias("x"),
        F.when(F.col("id") < 200, F.col("id") % 2).otherwise((F.col("id") % 400 == 0).cast("int")).alias("y"))
    history = []
    model = fit_additive(df, "y", ["c", "x"], "binary", history=history)
    got = {r["c"]: r["p"] for r in predict(df, model).groupBy("c").agg(F.avg("probability").alias("p")).collect()}
    assert got["hot"] == pytest.approx(0.5, abs=0.02) and got["cold"] == pytest.approx(0.0025, abs=0.0005)
    assert history == sorted(history, reverse=True)


@pytest.mark.parametrize("wide", [0, 21])
def test_one_method_at_every_size(spark, wide):
    """Features that go together, without and with 4,200 more bins: residuals sum to zero in every bin, as least squares asks."""
    u = F.col("id") * 7919 % 1009
    more = [f"w{i}" for i in range(wide)]
    df = spark.range(8000).select(
        "id", (u % 8).cast("double").alias("a"), ((u % 8) + (F.col("id") % 3)).cast("double").alias("b"),
        F.concat(F.lit("c"), (u % 5).cast("string")).alias("c"),
        *[F.concat(F.lit("k"), F.pmod(F.xxhash64("id", F.lit(m)), F.lit(200)).cast("string")).alias(m) for m in more])
    df = df.withColumn("y", F.sin("a") * 3 + F.col("b") * 2 + F.when(F.col("c") == "c1", 4.0).otherwise(0.0) + F.pmod(F.hash("id"), F.lit(100)) / 50)
    history, features = [], ["a", "b", "c", *more]
    model = fit_additive(df, "y", features, "regression", bags=1, max_leaves=16, learning_rate=1.0, rounds=12, passes=40, history=history)
    out = predict(df, model).select(*features, (F.col("y") - F.col("prediction")).alias("left")).toPandas()
    assert max(out.groupby(f)["left"].sum().abs().max() for f in features) < 0.2
    assert all(b <= a for a, b in zip(history, history[1:]))


def test_rows_that_do_not_collapse(rows, monkeypatch):
    from glasswork.operators import additive

    whole = fit_additive(rows, "r", ["x", "c"], "regression", bags=1)
    monkeypatch.setattr(additive, "MAX_CELLS", 1)
    single = fit_additive(rows, "r", ["x", "c"], "regression", bags=1)
    for a, b in zip(whole.terms, single.terms):
        assert all(math.isclose(a.scores[i][0], b.scores[i][0], abs_tol=1e-6) for i in a.scores)


def test_isotonic_is_monotone(rows):
    scored = rows.select("y", F.round("p", 3).alias("p"))
    fit = isotonic_calibrate(scored)
    assert isinstance(fit, Isotonic) and list(fit.ys) == sorted(fit.ys)
    assert isinstance(calibrate(scored), Isotonic)
    assert isinstance(calibrate(scored.limit(900)), Platt)
    with pytest.raises(ValueError):
        calibrate(scored, method="other")


def test_tree_nodes(rows, spark):
    model = fit_tree(rows.dropna(), "y", ["x", "z"], "binary", max_depth=3)
    assert model.nodes[0].feature == "x" and abs(model.nodes[0].threshold - 6) < 0.3
    assert sum(n.rows for n in model.leaves) == model.nodes[0].rows
    shares = {r["feature"]: r["importance"] for r in gini_importance(spark, model).collect()}
    assert math.isclose(sum(shares.values()), 1.0) and shares["x"] > 0.8


CONFIGS = [("ebm", {"rounds": 30, "passes": 2, "bags": 1, "max_bins": 16}), ("l_regression", {}), ("decision_tree", {"max_depth": 4})]


@pytest.mark.parametrize("kind,params", CONFIGS)
@pytest.mark.parametrize("target,column", [("y", "probability"), ("k", "prediction"), ("r", "prediction")])
def test_run_and_exported_sql(rows, kind, params, target, column):
    """Train on the table, run the emitted SQL in another engine, compare with the model."""
    import duckdb

    data = rows.select("id", "x", "z", "c", target)
    if target == "r" and kind == "l_regression":
        params = {"alpha": 0.1}
    features = ["x", "z", "c"] if kind == "ebm" else ["z", "x"]
    config = {"target": target, "features": features, "model_params": params, "post_params": {"sql_split": "true"}}
    result = flows.run(data if kind == "ebm" else data.dropna(), config, kind, ["id"])
    assert result.predictions.filter("data_type = 'test'").count() == (data if kind == "ebm" else data.dropna()).count()
    sample = (data if kind == "ebm" else data.dropna()).orderBy("id").limit(99)
    want = [r[0] for r in predict(sample, result.model).select(
        column if not (kind == "decision_tree" and target == "y") else "prediction").collect()]
    con = duckdb.connect()
    con.register("t", sample.toPandas())
    text = result.sql.replace("<source_table>", "t")
    name = "prediction" if kind == "decision_tree" else column
    got = [r[0] for r in con.execute(f"SELECT {name} FROM ({text})").fetchall()]
    if isinstance(want[0], str):
        assert np.mean([a != b for a, b in zip(want, got)]) <= 1e-4
    else:
        assert max(abs(a - b) / max(abs(a), 1e-9) for a, b in zip(want, got)) <= 1e-4
    assert all(t.limit(1).count() >= 0 for t in list(result.tables.values())[:2])


def test_run_with_every_option(rows):
    """Out-of-time rows, upsampling, calibration, row limit."""
    skewed = rows.filter((F.col("y") == 0) | (F.col("id") % 4 == 0)).dropna()
    config = {"target": "y", "features": ["x", "z"], "model_params": {"max_depth": 3}, "pre_params": {
        "max_rows": 3000, "oot_set": "true", "oot_rows": 200, "time_sensitive_column": "id", "upsampling": "true"}}
    result = flows.run(skewed, config, "decision_tree", ["id"])
    sizes = {r["data_type"]: r["count"] for r in result.predictions.groupBy("data_type").count().collect()}
    assert sizes == {"train": 2800, "test": 2800, "oot": 200}
    assert result.calibrator is not None
    auc = {r["data_type"]: r["auc"] for r in result.tables["roc_auc"].collect()}
    assert set(auc) == {"train", "test", "oot"} and auc["test"] > 0.6


def test_time_series_run(rows):
    config = {"target": "r", "features": ["x", "z"], "model_params": {"alpha": 0.0},
              "pre_params": {"cv_type": "timeseriesplit", "time_sensitive_column": "id"}}
    result = flows.run(rows.dropna(), config, "l_regression", ["id"])
    n = rows.dropna().count()
    assert result.predictions.filter("data_type = 'test'").count() == n // 6 * 5


def test_run_on_unusual_columns(rows):
    """A boolean target, NaN in a feature and a date column that is no feature."""
    data = rows.limit(600).select("id", F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("x")).alias("x"), "c",
                                  F.expr("date'2024-01-01' + cast(id as int)").alias("day"), (F.col("y") == 1).alias("flag"))
    config = {"target": "flag", "model_params": {"rounds": 20, "passes": 2, "bags": 1, "max_bins": 8}}
    result = flows.run(data, config, "ebm", ["id"])
    assert result.features == ("x", "c") and result.model.classes == (0, 1)
    assert result.predictions.filter("probability IS NULL OR isnan(probability)").count() == 0
    assert {r["predicted"] for r in result.tables["confusion_matrix"].collect()} <= {0, 1}


def test_clean_data_flow(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("a,d,m\n1,2020-01-01,5USD\nx,2020-01-02,6USD\n3,2020-01-03,7.5EUR\n")
    out = flows.clean_data(spark, str(path))
    got = spark.read.csv(out, header=True)
    assert out.endswith("raw_processed") and {"a_numeric", "m_amount", "m_currency", "d_year"} <= set(got.columns)


def test_single_class_curves(spark):
    df = spark.createDataFrame([(1, 0.2, 0), (1, 0.4, 0), (0, 0.1, 1), (1, 0.9, 1), (None, 0.5, 1), (1, None, 1)],
                               "y int, p double, fold int")
    got = {r["fold"]: r["auc"] for r in ev.roc_auc(df, by=["fold"]).collect()}
    assert got == {0: None, 1: 1.0}
    assert ev.roc_curve(df.limit(0)).count() == 0
    pr = ev.pr_curve(df, by=["fold"]).filter("fold = 0").collect()
    assert {(r["precision"], r["recall"]) for r in pr} >= {(1.0, 0.0), (1.0, 1.0)}


def test_constant_target_metrics(spark):
    df = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0), (2.0, 2.0)], "y double, prediction double")
    got = {r["metric"]: r["value"] for r in ev.regression_metrics(df).collect()}
    assert got["r2"] == 1.0 and got["mae"] == 0.0 and got["median_ae"] == 0.0
    assert ev.quantile_error(df).first()["n"] == 3


def test_standard_errors_shrink_with_the_rows(spark):
    """Four categories and a binary target: the error of a bin is about that of its log odds, and falls as one over root n."""
    def errors(n):
        df = spark.range(n).select("id", F.concat(F.lit("c"), F.col("id") % 4).alias("c"),
                                   (F.pmod(F.xxhash64("id"), F.lit(10)) < F.col("id") % 4 + 2).cast("int").alias("y"))
        model = fit_additive(df, "y", ["c"], "binary", keys=["id"], bags=32)
        return [v[0] for k, v in model.terms[0].stderr.items() if v[0] > 0]

    few, many = errors(2_000), errors(200_000)
    assert len(few) == len(many) == 4
    for k in range(4):
        p = (k + 2) / 10
        assert 0.4 < np.mean(few) / np.sqrt(1 / (500 * p * (1 - p))) < 2.5
    assert 5 < np.mean(few) / np.mean(many) < 20


def test_nulls_in_fits(spark):
    from glasswork.operators.linear import fit_linear, fit_logistic

    df = spark.range(200).select(F.when(F.col("id") % 4 != 0, F.col("id").cast("double")).alias("x"),
                                 F.when(F.col("id") % 4 == 0, 500.0).otherwise(F.when(F.col("id") < 100, 1.0).otherwise(9.0)).alias("r"),
                                 (F.col("id") % 4 == 0).cast("int").alias("y"))
    with pytest.raises(ValueError, match="50 rows"):
        fit_linear(df, "r", ["x"])
    with pytest.raises(ValueError, match="50 rows"):
        fit_logistic(df.withColumn("y", (F.col("r") > 5).cast("int")), "y", ["x"])
    assert fit_linear(df, "r", ["x"], nulls="drop").features == ("x",)
    tree = fit_tree(df, "r", ["x"], "regression", max_depth=3)
    got = predict(df, tree).groupBy(F.col("x").isNull().alias("hole")).agg(F.avg(F.abs(F.col("prediction") - F.col("r"))).alias("e")).collect()
    assert {r.hole: r.e for r in got} == {True: 0.0, False: 0.0}


def test_evaluate_keeps_groups_apart(spark):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("data_type"),
                                 F.col("id").cast("double").alias("y"), (F.col("id") + F.col("id") % 2 * 5).cast("double").alias("prediction"))
    out = ev.evaluate(df, "regression", "y")
    assert {(r.data_type, r.n) for r in out["quantile_error"].groupBy("data_type").agg(F.sum("n").alias("n")).collect()} == {("train", 200), ("test", 200)}
    assert {(r.data_type, r["median"]) for r in out["quantile_error"].collect()} == {("train", 0.0), ("test", 5.0)}
    assert out["prediction_pairs"].groupBy("data_type").count().count() == 2


def test_parameter_names():
    """Names that configurations use are mapped; an unknown one is told together with the known ones."""
    from glasswork.operators.linear import fit_logistic

    assert flows.model_params("ebm", fit_additive, {"max_rounds": 9, "outer_bags": 2, "max_bins": 8}) == {"rounds": 9, "bags": 2, "max_bins": 8}
    assert flows.model_params("decision_tree", fit_tree, {"min_samples_leaf": 3}) == {"min_rows": 3}
    with pytest.raises(ValueError, match="no parameter depth; it knows .*max_depth"):
        flows.model_params("decision_tree", fit_tree, {"depth": 3})
    with pytest.raises(ValueError, match="l_regression has no parameter alpha"):
        flows.model_params("l_regression", fit_logistic, {"alpha": 3})


def test_run_gives_curves_per_fold(rows):
    """Fold tables are of the out-of-fold rows, and their mean is the mean of the folds."""
    config = {"target": "y", "features": ["x", "c"], "model_params": {"rounds": 20, "passes": 2, "bags": 1, "max_bins": 8}}
    result = flows.run(rows.select("id", "x", "c", "y"), config, "ebm", ["id"])
    scores = result.tables["fold_scores"].collect()
    assert sorted(r["fold"] for r in scores) == list(range(5)) and {r["data_type"] for r in scores} == {"test"}
    mean = result.tables["fold_means"].first()
    assert mean["mean_roc_auc"] == pytest.approx(np.mean([r["roc_auc"] for r in scores]))
    curve = {round(r["x"], 4): r for r in result.tables["mean_roc_curve"].collect()}
    assert len(curve) == 101 and curve[1.0]["mean"] == 1.0 and all(r["folds"] == 5 for r in curve.values())
    values = [curve[i / 100]["mean"] for i in range(101)]
    assert values == sorted(values) and abs(np.trapezoid(values, dx=0.01) - mean["mean_roc_auc"]) < 0.02


@pytest.mark.parametrize("alpha", [0.0, 0.3])
@pytest.mark.parametrize("time_series", [False, True])
def test_folds_from_one_scan(spark, alpha, time_series):
    """Each fold's predictions and the final model are those of separate fits; nulls and constants are handled alike."""
    from glasswork.operators.linear import cross_fit_linear, fit_linear

    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]]) + [1000.0, -3.0, 0.0]
    y = x @ [2.0, -1.0, 0.1] + rng.normal(size=600)
    data = [(i, i % 4 if i % 97 else None, *map(float, r), float(v), 7.0) for i, (r, v) in enumerate(zip(x, y))]
    data = [(d[0], d[1], None if d[0] % 50 == 0 else d[2], *d[3:]) for d in data]
    df = spark.createDataFrame(data, "id int, fold int, a double, b double, c double, y double, one double")
    features = ["a", "b", "c", "one"]
    model, out = cross_fit_linear(df, "y", features, alpha=alpha, time_series=time_series)
    got = {r["id"]: r["prediction"] for r in out.collect()}
    folds = [1, 2, 3] if time_series else [0, 1, 2, 3]
    assert set(got) == {d[0] for d in data if d[1] in folds}
    assert all((got[i] is None) == (i % 50 == 0) for i in got)
    for k in folds[:2]:
        one = fit_linear(df.filter(F.col("fold") < k if time_series else F.col("fold") != k), "y", features, alpha=alpha, nulls="drop")
        for r in predict(df.filter(F.col("fold") == k).dropna(), one).select("id", "prediction").collect():
            assert got[r["id"]] == pytest.approx(r["prediction"], abs=2e-3)
    whole = fit_linear(df.filter("fold IS NOT NULL"), "y", features, alpha=alpha, nulls="drop")
    assert np.allclose(model.coefficients[0], whole.coefficients[0], atol=1e-3)
    _, none = cross_fit_linear(df.limit(0), "y", features, alpha=alpha)
    assert none.collect() == [] and "prediction" in none.columns


def test_elastic_net_is_optimal():
    """The gradient balances the penalty in every coefficient, and stays within it where one is 0."""
    from glasswork.operators.linear import solve_products

    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4)) + [50.0, 0, 0, -9]
    y = x @ [1.5, 0.0, -0.4, 0.02] + rng.normal(size=500) + 3
    shift = np.array([*x[:9].mean(0), y[:9].mean()])
    z = np.column_stack([np.ones(500), x - shift[:-1], y - shift[-1]])
    for alpha, ratio in ((0.4, 1.0), (0.7, 0.3), (1e9, 1.0)):
        intercept, b = solve_products(shift, z.T @ z, alpha, ratio)
        slope = (x - x.mean(0)).T @ (y - intercept - x @ b) / 500 - alpha * (1 - ratio) * b
        assert abs((y - intercept - x @ b).mean()) < 1e-8
        assert np.all(np.abs(slope) <= alpha * ratio * (1 + 1e-9) + 1e-8)
        assert np.allclose(slope[b != 0], alpha * ratio * np.sign(b[b != 0]), atol=1e-7)


@pytest.mark.parametrize("accuracy", [20, 200])
def test_sketched_edges_keep_their_error(spark, accuracy):
    """Every edge's rank is within rows / accuracy of the wanted one, whatever the number of parts."""
    df = spark.range(20_000).repartition(7).select((F.pmod(F.xxhash64("id"), F.lit(10**6)) / 1e6).alias("p"), (F.col("id") % 2).cast("int").alias("y"))
    curve = sorted(ev.calibration_curve(df, accuracy=accuracy).collect(), key=lambda r: r["bin"])
    below = np.cumsum([r["n"] for r in curve])
    assert len(curve) == 10 and below[-1] == 20_000
    assert all(abs(n - 2_000 * (i + 1)) <= 20_000 / accuracy + 1 for i, n in enumerate(below[:-1]))


def test_fine_calibration_edges_take_no_sketch(spark):
    """Edges of a high accuracy are the scores at the wanted ranks, and no sketch of all rows is built."""
    df = spark.range(2_000).select((F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 100 / 100).alias("p"))
    curve = ev.calibration_curve(df, accuracy=10_000_000)
    assert "10000000" not in curve._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["bin"], r["n"]) for r in sorted(curve.collect(), key=lambda r: r["bin"])] == [(i, 200) for i in range(10)]


def test_tree_reads_its_rows_twice_and_leaves_no_cache(spark):
    """Once for the range of the features and once into the cache of the learner's passes."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = spark.range(2000, numPartitions=4).selectExpr("double(id) AS x", "IF(id % 9 = 0, NULL, double(id % 50)) AS z",
                                                         "IF(id < 700, 'a', 'b') AS y")
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    model = fit_tree(rows.mapInArrow(counted, rows.schema), "y", ["x", "z"], "multiclass", max_depth=3, classes=("a", "b", "c"))
    assert reads.value <= 2 * 2000
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached
    # A class that the rows lack still has its place in every node.
    assert model.nodes[0].value == (700.0, 1300.0, 0.0) and model.nodes[0].feature == "x"


def test_run_of_trees_leaves_no_cache(spark):
    rows = spark.range(600).selectExpr("id", "double(id % 37) AS x", "double(id % 11) AS z", "concat('c', id % 37 % 3) AS y")
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    result = flows.run(rows, {"target": "y", "features": ["x", "z"], "model_params": {"max_depth": 3}}, "decision_tree", ["id"])
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached
    assert result.tables["confusion_matrix"].groupBy("data_type").sum("n").collect()
