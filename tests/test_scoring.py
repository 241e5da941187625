"""Columns, exported text in Spark and the same text in another engine must agree."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glasswork.functions.scoring import model_sql
from glasswork.functions.sqltext import alias, number
from glasswork.models import AdditiveModel, LinearModel, Node, TreeModel, category_axis, numeric_axis, pair_term, single_term
from glasswork.operators.calibrate import Isotonic, Platt
from glasswork.operators.score import class_vectors, export_sql, predict, round_model, run_sql_model, score, score_term
from glasswork.sources.store import load_model, save_model
from registry.common import BINARY, LOGIT, MULTI, PRICE, PRICE_TREE, SOFTMAX, TREE

ROWS = [(i, *v) for i, v in enumerate([
    (5.5, 0.015, 0.025, "F"), (5.6, 0.016, 0.026, "O"), (None, 0.1, 0.0, "F"), (50.0, None, None, None),
    (12.0, 0.075, 0.04, "X"), (35.0, 0.05, 0.041, "it's"), (24.5, 0.045, 0.055, "O"), (1e9, -5.0, 99.0, "")])]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        ROWS, "id long, l_quantity double, l_discount double, l_tax double, l_linestatus string").cache()


def run_duck(sql, rows, column):
    con = duckdb.connect()
    con.register("t", rows.toPandas())
    return [None if r[0] is None or (isinstance(r[0], float) and math.isnan(r[0])) else r[0]
            for r in con.execute(f"SELECT {column} FROM ({sql.replace('<source_table>', 't')})").fetchall()]


def close(a, b):
    if a is None or b is None or isinstance(a, str):
        return a == b
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("model,column", [
    (BINARY, "probability"), (PRICE, "prediction"), (MULTI, "probability_N"), (MULTI, "prediction"),
    (LOGIT, "probability"), (SOFTMAX, "probability_R"), (SOFTMAX, "prediction"), (TREE, "prediction"),
    (PRICE_TREE, "prediction")])
def test_columns_and_text_agree(rows, model, column, split):
    ordered = rows.orderBy("id")
    mine = [r[0] for r in score(ordered, model).select(column).collect()]
    text = export_sql(model, split=split)
    spark_text = [r[0] for r in run_sql_model(text, ordered).select(column).collect()]
    duck = run_duck(text, ordered, column)
    assert all(close(a, b) for a, b in zip(mine, spark_text))
    assert all(close(a, b) for a, b in zip(mine, duck))


def test_boundaries_missing_and_unseen(rows):
    got = {r["id"]: r for r in score(rows, BINARY).collect()}
    assert got[0]["l_quantity_score"] == -0.31  # right-closed
    assert got[1]["l_quantity_score"] == -0.12
    assert got[2]["l_quantity_score"] == 0.05  # missing
    assert got[4]["l_linestatus_score"] == 0.0  # unseen category


def test_names_and_literals_are_quoted(spark):
    model = AdditiveModel("o'neil", "binary", "y", (0.0,), (
        single_term("odd name", "categorical", category_axis(["it's", 'a"b']), [0.5, 1.0, 2.0]),
        single_term("sel`ect", "numeric", numeric_axis([1.0]), [0.0, -1.0, 1.0])), (0, 1))
    df = spark.createDataFrame([("it's", 0.5), ('a"b', 2.0), (None, None)], "`odd name` string, `sel``ect` double")
    mine = [r[0] for r in score(df, model).select("probability").collect()]
    assert all(close(a, b) for a, b in zip(mine, run_duck(model_sql(model), df, "probability")))
    spark_text = run_sql_model(model_sql(model, dialect="spark"), df).select("probability").collect()
    assert all(close(a, b[0]) for a, b in zip(mine, spark_text))
    assert alias("a b-c") == "a_b_c"


def test_degenerate_axes(spark):
    """A single open bin, an axis with the missing bin only, and a missing bin equal to its neighbour."""
    model = AdditiveModel("m", "regression", "y", (1.0,), (
        single_term("a", "numeric", numeric_axis([]), [5.0, 7.0]),
        single_term("b", "numeric", numeric_axis([])[:1], [3.0]),
        single_term("c", "numeric", numeric_axis([0.0]), [2.0, 2.0, 9.0])))
    df = spark.createDataFrame([(1.0, 1.0, None), (None, None, -1.0), (1.0, None, 1.0)], "a double, b double, c double")
    want = [1 + 7 + 0 + 2, 1 + 5 + 3 + 2, 1 + 7 + 3 + 9]
    assert [r[0] for r in predict(df, model).select("prediction").collect()] == want
    assert run_duck(model_sql(model), df, "prediction") == want


def test_pair_grid_larger_than_one_method(spark):
    cuts = [float(i) for i in range(60)]
    axis = numeric_axis(cuts)
    grid = [[i * 1000.0 + j for j in range(len(axis))] for i in range(len(axis))]
    model = AdditiveModel("m", "regression", "y", (0.0,), (
        pair_term(("a", "b"), ("numeric", "numeric"), (axis, axis), grid),))
    df = spark.range(0, 62).select((F.col("id") - 0.5).alias("a"), (60.5 - F.col("id")).alias("b"))
    got = [r[0] for r in predict(df, model).select("prediction").collect()]
    assert got == [1000.0 * (1 + min(i, 60)) + (1 + min(61 - i, 60)) for i in range(62)]


def test_round_trip(spark, rows, tmp_path):
    for model in (BINARY, PRICE, MULTI, LOGIT, SOFTMAX, TREE, PRICE_TREE):
        path = str(tmp_path / model.name)
        save_model(spark, model, path)
        assert load_model(spark, path) == model


def test_round_model_and_number():
    model = LinearModel("l", "regression", "y", ("x",), (1.0,), ((0.123456,),))
    assert round_model(model, 3).coefficients == ((0.123,),)
    assert number(0.1) == "0.1E0" and number(1e-7) == "1e-07"
    with pytest.raises(ValueError):
        number(float("inf"))


def test_export_writes_text(spark, tmp_path):
    path = str(tmp_path / "model_in_sql")
    text = export_sql(TREE, path, spark=spark)
    assert "\n".join(r[0] for r in spark.read.text(path).collect()) == text


def test_calibrators_as_text(spark):
    df = spark.createDataFrame([(float(i) / 20,) for i in range(21)], "p double")
    iso = Isotonic((0.2, 0.4, 0.4, 0.8), (0.1, 0.3, 0.5, 0.9))
    got = {round(r[0], 2): r[1] for r in df.select("p", iso.column("p")).collect()}
    assert got[0.0] == 0.1 and got[1.0] == 0.9
    assert got[0.3] == pytest.approx(0.2) and got[0.6] == pytest.approx(0.7)
    values = [got[k] for k in sorted(got)]
    assert values == sorted(values)
    text = export_sql(BINARY, split=True, calibrator=Platt(2.0, -1.0))
    assert "calibrated_probability" in text


def test_stream_scoring(spark, sf, tmp_path):
    from glasswork.streaming.scoring import score_stream

    batch = spark.read.parquet(f"{sf}/lineitem.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = (score_stream(stream, MULTI).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("prediction").count().collect()
    want = predict(batch, MULTI).groupBy("prediction").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    with pytest.raises(ValueError):
        score_stream(batch, MULTI)


def test_tree_null_goes_right(spark):
    tree = TreeModel("t", "regression", "y", ("x",), (Node(0, (0.0,), 2, "x", 1.0, 1, 2, 1.0), Node(1, (10.0,)), Node(2, (20.0,))))
    df = spark.createDataFrame([(1.0,), (1.1,), (None,)], "x double")
    assert [r[0] for r in predict(df, tree).select("prediction").collect()] == [10.0, 20.0, 20.0]


def test_export_on_pandas_frame():
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"l_quantity": [1.0, 30.0], "l_discount": [0.0, 0.06]}))
    out = con.execute(model_sql(TREE, source="t")).fetchall()
    assert out == [("A",), ("N",)]


def test_generated_methods_stay_small(spark, rows):
    score(rows, BINARY)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


@pytest.mark.parametrize("bounds", [[], [1.0], [0.0, 1.0], [-3.5, 0.0, 0.25, 7.0, 9.0], [float(i) for i in range(1000)]])
def test_search_counts_bounds_below(spark, bounds):
    """Every value against every bound, NaN above all, null as 0."""
    from glasswork.functions.sqltext import doubles, search

    values = [-10.0, -3.5, 0.0, 0.1, 0.25, 1.0, 7.0, 8.5, 512.0, 999.0, 1e9, float("nan"), None]
    array = doubles(bounds) if bounds else "cast(array() AS array<double>)"
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(F.expr(search("v", array, len(bounds)))).collect()]
    assert got == [0 if v is None else len(bounds) if v != v else sum(b < v for b in bounds) for v in values]


def test_wide_axis_scores_like_a_narrow_one(spark, monkeypatch):
    """The searched form, the CASE form and the interval table agree, borders, nulls and NaN included."""
    from glasswork.functions import sqltext
    from glasswork.operators.intervals import interval_lookup

    cuts = [float(i * i) for i in range(40)]
    term = single_term("x", "numeric", numeric_axis(cuts), [9.0, *[i * 0.5 for i in range(41)]])
    vector = AdditiveModel("m", "multiclass", "y", (0.0, 0.0), (single_term(
        "x", "numeric", numeric_axis(cuts), [(9.0, 8.0), *[(i * 0.5, -i) for i in range(41)]]),), ("a", "b"))
    values = [None, float("nan"), -1.0, 0.0, 0.5, 1.0, 3.9, 4.0, 1521.0, 1521.5, 1e12]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, lo int")
    plain = [r[0] for r in score_term(df, term).orderBy("lo").select("x_score").collect()]
    plain_vector = [r[0] for r in class_vectors(df, vector).orderBy("lo").select("class_scores").collect()]
    monkeypatch.setattr(sqltext, "SEARCH_LIMIT", 4)
    assert [r[0] for r in score_term(df, term).orderBy("lo").select("x_score").collect()] == plain
    assert [r[0] for r in class_vectors(df, vector).orderBy("lo").select("class_scores").collect()] == plain_vector
    edges = [None, *cuts, None]
    cells = spark.createDataFrame([(a, b, i * 0.5) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "lo double, hi double, score double")
    got = [r[0] for r in interval_lookup(df, "x", cells, "s", default=9.0, packed=7).orderBy("lo").select("s").collect()]
    assert got == plain
    holes = interval_lookup(df, "x", cells.filter("lo = 1"), "s", default=-1.0).orderBy("lo")
    assert [r[0] for r in holes.select("s").collect()] == [-1.0] * 6 + [1.0, 1.0] + [-1.0] * 3
    assert [r[0] for r in interval_lookup(df, "x", cells.limit(0), "s").select("s").collect()] == [0.0] * len(values)


def test_many_categories_score_like_few(spark, monkeypatch):
    """Searched categories equal the CASE form: quotes, backslashes, order by bytes, empty, unseen and null values."""
    from glasswork.functions import sqltext

    names = ["it's", "a", "Z", "", "é", "日", "a\\b", "𝔘", "zz", 'say "x"', "�", " a"]
    term = single_term("x", "categorical", category_axis(names), [9.0, *[i * 0.5 + 1 for i in range(len(names))]])
    values = [*names, None, "unseen", "A"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x string, i int")
    want = [*[i * 0.5 + 1 for i in range(len(names))], 9.0, 0.0, 0.0]
    monkeypatch.setattr(sqltext, "SEARCH_CATEGORIES", 3)
    assert [r[0] for r in score_term(df, term).orderBy("i").select("x_score").collect()] == want
    from glasswork.functions.scoring import index_text
    places = [r[0] for r in df.orderBy("i").select(F.expr(index_text("x", term.axes[0]))).collect()]
    assert places == [*range(1, len(names) + 1), 0, len(names) + 1, len(names) + 1]
