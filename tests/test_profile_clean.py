import pytest
from pyspark.sql import functions as F

from glasswork.operators import clean, profile
from glasswork.plans.options import Options
from glasswork.sources.tables import DEFAULT_NULLS, read_table, sample_scan, write_clean


def frame(spark, values, kind="int", name="target"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


@pytest.mark.parametrize("values,verdict", [
    ([1, 0, 0, 1, 1], "ok"), ([7, 7], "constant"), ([5, 9, 9, 5], "not_0_1"), ([None, 1, 0], "ok"), ([4, 5, 6, 7], "ok")])
def test_check_target(spark, values, verdict):
    df = frame(spark, values, name="label")
    assert profile.check_target(df, "label").first()["verdict"] == verdict
    if verdict == "constant":
        with pytest.raises(ValueError):
            profile.require_target(df, "label")


def test_null_counts(spark):
    df = spark.createDataFrame([("p", None, 1), (None, None, 2), ("q", 2.5, 3), (None, 0.0, 4)], "tag string, weight double, n int")
    assert {r["column"]: r["nulls"] for r in profile.null_counts(df).collect()} == {"tag": 2, "weight": 2}
    assert profile.null_counts(df.select("n")).count() == 0


@pytest.mark.parametrize("values,kind", [
    (["1999-12-31", "2004-02-29", None], "timestamp"), (["red", "green"], "string"), (["8", "eight", "1999-12-31"], "string"),
    (["-4", "11"], "bigint"), (["6", "-0.25", None], "double"), (["1987", "2063"], "bigint"), (["false", "True", "false"], "boolean"),
    (["3d", "4"], "string")])
def test_infer_types(spark, values, kind):
    assert profile.infer_types(frame(spark, values, "string", "v")) == {"v": kind}


def test_select_features(spark):
    df = spark.range(120).select(
        (F.col("id") * 7 + 11).alias("ticket"), F.lit(3.5).alias("fee"), F.concat(F.lit("u-"), F.col("id").cast("string")).alias("user"),
        F.expr("timestamp'2011-06-01' + make_interval(0, 0, 0, cast(id as int))").alias("seen_at"),
        F.sqrt(F.col("id") + 0.5).alias("distance"), F.element_at(F.array(F.lit("n"), F.lit("e"), F.lit("w")), (F.col("id") % 3 + 1).cast("int")).alias("side"),
        (F.col("id") % 9).alias("floor"))
    for approx in (False, True):
        assert profile.select_features(df, approx=approx) == ["distance", "side", "floor"]
    assert profile.select_features(df.select("side", "distance")) == ["side", "distance"]


def test_infer_task(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("ten"), (F.col("id") % 11).alias("eleven"),
                                 (F.col("id") / 3).alias("f"), F.col("id").cast("string").alias("s"),
                                 F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("holes"))
    got = {c: profile.infer_task(df, c) for c in df.columns}
    assert got == {"ten": "classification", "eleven": "regression", "f": "regression", "s": "classification",
                   "holes": "classification"}


def test_read_csv_with_null_tokens(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('a,b,c\n1,x,2020-01-02\nN/A,"p, q",None\n3.5,NULL,2020-02-03\n')
    df = read_table(spark, str(path))
    assert dict(df.dtypes) == {"a": "double", "b": "string", "c": "string"}
    assert [tuple(r) for r in df.collect()] == [(1.0, "x", "2020-01-02"), (None, "p, q", None), (3.5, None, "2020-02-03")]
    write_clean(df, str(tmp_path / "out"))
    assert read_table(spark, str(tmp_path / "out"), DEFAULT_NULLS).count() == 3


def test_sample_scan_steps(spark):
    assert 350 < sample_scan(spark.range(1000), ["id"]).count() < 650
    assert 500 < sample_scan(spark.range(20000), ["id"]).count() < 1500


def test_quick_clean_rules(spark):
    rows = [("1 234", "none", "7", "True", "$ 1,200.50USD", "2020-01-31"),
            ("56", "x", "abc", "false", "3 EUR", "2020-02-01"),
            ("7", "y", "9", None, "2.5GBP", "2020-02-03")]
    df = spark.createDataFrame(rows, "n string, s string, m string, b string, money string, d string")
    flags = clean.detect(df)
    assert flags["n"]["spaced"] and flags["s"]["null_strings"] and flags["m"]["mixed"] and flags["m"]["text_left"]
    assert flags["b"]["boolean"] and flags["money"]["money"] and flags["d"]["date"]
    assert not flags["m"]["date"] and not flags["money"]["date"]
    out = clean.quick_clean(df)
    got = out.collect()
    assert [r["money_amount"] for r in got] == [1200.5, 3.0, 2.5]
    assert [r["money_currency"] for r in got] == ["USD", "EUR", "GBP"]
    assert "money" not in out.columns and "d" not in out.columns
    assert [r["d_dayofweek_int"] for r in got] == [4, 5, 0]
    assert got[0]["d_month_1"] is True and got[1]["d_month_1"] is False
    assert got[0]["s"] is None and [r["b_boolean"] for r in got] == [True, False, None]


def test_clean_pipeline_order(spark):
    rows = [(i, "A" if i % 2 else "B", 1.0, None if i % 3 else 2.0, "True" if i % 2 else "False", True, float(i)) for i in range(20)]
    rows += [(98, "single", 1.0, 1.0, "True", False, 3.0), (99, None, 5.0, 1.0, "x", False, 3.0)]
    df = spark.createDataFrame(rows, "id int, y string, one double, sparse double, flag string, b boolean, x double")
    out, features = clean.clean_pipeline(df, "y", ["one", "sparse", "flag", "b", "x"], "ebm", "classification")
    assert features == ["flag", "b", "x"] and out.count() == 20
    assert dict(out.dtypes)["flag"] == "int" and dict(out.dtypes)["b"] == "int"
    text = df.withColumn("t", F.concat(F.lit("t"), (F.col("id") % 3).cast("string")))
    assert clean.clean_pipeline(text, "y", ["t", "x"], "decision_tree", "classification")[1] == ["x"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, y int")
    assert clean.drop_sparse_columns(df).columns == ["a", "y"]
    assert clean.drop_singleton_classes(df, "y").count() == 0
    assert profile.null_counts(df).count() == 0


def test_options():
    columns = ["y", "a", "b", "t"]
    o = Options.from_config({"target": "y"}, columns)
    assert o.features == ("a", "b", "t") and o.cv_type == "kfold_cv" and not o.upsampling
    assert o.calibration is None and not o.sql_split and o.sql_decimals == 15 and o.oot_rows == 0
    o = Options.from_config({"target": "y", "features": ["a"], "pre_params": {
        "cv_type": "timeseriessplit", "time_sensitive_column": "t", "upsampling": "true", "oot_set": "true", "oot_rows": 5},
        "post_params": {"sql_split": True}}, columns)
    assert o.time_series and o.upsampling and o.calibration == "auto" and o.sql_split and o.oot_rows == 5
    with pytest.raises(ValueError):
        Options.from_config({"target": "y", "features": ["zz"]}, columns)
    with pytest.raises(ValueError):
        Options.from_config({"target": "y", "pre_params": {"cv_type": "timeseriesplit"}}, columns)
