import numpy as np
import pytest
from pyspark.sql import functions as F

from glasswork.operators import binning, neighbors, ranks, resample, splits
from glasswork.operators.neighbors import nearest


@pytest.fixture(scope="module")
def hot(spark):
    """Ten thousand rows; one class, one time and one feature row hold most of them."""
    big = F.col("id") % 10 < 7
    return spark.range(10000).select(
        "id", F.when(big, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 10).cast("string"))).alias("y"),
        F.when(big, 5).otherwise(F.col("id") % 97).alias("t"), (F.col("id") * 7919 % 1000 / 10).alias("v")).cache()


def test_kfold_is_a_partition(hot):
    folds = splits.kfold(hot, ["id"]).groupBy("fold").count().collect()
    assert {r["fold"] for r in folds} == set(range(5)) and sum(r["count"] for r in folds) == 10000


def test_stratified_is_even(hot):
    sizes = splits.stratified_kfold(hot, "y", ["id"]).groupBy("y", "fold").count().groupBy("y").agg(
        F.max("count").alias("hi"), F.min("count").alias("lo")).collect()
    assert all(r["hi"] - r["lo"] <= 1 for r in sizes)


def test_positions_with_a_hot_time(hot):
    got = ranks.row_positions(hot, "t", ["id"]).select("id", "t", "position").collect()
    assert sorted(r["position"] for r in got) == list(range(10000))
    by_position = sorted(got, key=lambda r: r["position"])
    assert all(a["t"] <= b["t"] for a, b in zip(by_position, by_position[1:]))


def test_null_order_comes_first(spark):
    df = spark.range(50).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("t"))
    got = {r["id"]: r["position"] for r in ranks.row_positions(df, "t", ["id"]).collect()}
    assert all(got[i] < 25 for i in range(1, 50, 2)) and got[48] == 49


def test_time_series_split(hot):
    out = splits.time_series_split(hot, "t", ["id"])
    sizes = {(r["fold"], r["role"]): r["count"] for r in out.groupBy("fold", "role").count().collect()}
    test = 10000 // 6
    assert all(sizes[k, "test"] == test for k in range(1, 6))
    assert [sizes[k, "train"] for k in range(1, 6)] == [10000 - (6 - k) * test for k in range(1, 6)]


def test_oot_and_limit(hot):
    assert splits.oot_holdout(hot, "t", ["id"], 123).filter("is_oot").count() == 123
    assert splits.limit_rows(hot, ["id"], 777).count() == 777
    assert splits.limit_rows(hot, ["id"], 99999).count() == 10000


def test_quantiles_match_numpy(hot, spark):
    probs = [0, 0.1, 0.33, 0.5, 0.99, 1]
    got = {(r["y"], r["prob"]): r["quantile"] for r in ranks.quantiles(hot, "v", probs, ["y"]).collect()}
    for y in ("hot", "c8"):
        values = [r["v"] for r in hot.filter(F.col("y") == y).select("v").collect()]
        for p in probs:
            assert got[y, p] == pytest.approx(np.percentile(values, 100 * p))
    assert ranks.quantiles(hot.limit(0), "v", probs).count() == 0


def test_islands(spark):
    df = spark.range(2000).select("id", (F.floor(F.col("id") / 37) % 3).alias("v"))
    got = {r["id"]: r["island"] for r in ranks.island_ids(df, "id", F.col("v")).collect()}
    assert all(got[i] == i // 37 for i in range(2000))


def test_oversample_is_exact(hot):
    sizes = resample.random_oversample(hot, "y", ["id"]).groupBy("y").count().collect()
    assert len(sizes) == 4 and {r["count"] for r in sizes} == {7000}


def test_oversample_spreads_one_row(spark):
    df = spark.range(30001).select("id", F.when(F.col("id") == 0, "one").otherwise("many").alias("y"))
    sizes = resample.random_oversample(df, "y", ["id"]).groupBy("y").count().collect()
    assert {r["count"] for r in sizes} == {30000}


@pytest.mark.parametrize("rows", [0, 1, 7, 60, 95, 100, 150])
def test_holdout_takes_the_last_rows(spark, rows):
    """Against sorting: hot and null times, ties by hash, and more rows than there are times."""
    import hashlib

    data = [(i, None if i % 20 == 0 else 5.0 if i % 3 else float(i % 11)) for i in range(100)]
    df = spark.createDataFrame(data, "id int, t double")
    order = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0.0, hashlib.md5(f"42|{r[0]}".encode()).hexdigest()))
    want = {i for i, _ in order[len(order) - min(rows, len(order)):]} if rows else set()
    out = splits.oot_holdout(df, "t", ["id"], rows)
    assert out.columns == ["id", "t", "is_oot"]
    assert {r["id"] for r in out.filter("is_oot").collect()} == want and out.count() == 100


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(300, 3)), rng.normal(size=(100, 3)) * 0.01 + 5, rng.uniform(-50, 50, size=(50, 3))])
    cats = rng.integers(0, 3, size=len(x))
    df = spark.createDataFrame([(i, *map(float, p), f"c{c}") for i, (p, c) in enumerate(zip(x, cats))],
                               "id long, a double, b double, c double, k string")
    for cat, cost in (((), 0.0), (("k",), 2.25)):
        got = nearest(df.withColumn("w", F.lit(cost)), "id", ["a", "b", "c"], 5, cats=cat, cost="w", block=16)
        got = {r["id"]: [(round(n["distance"], 9), n["id"]) for n in r["neighbors"]] for r in got.collect()}
        d = ((x[:, None] - x[None]) ** 2).sum(2) + (cost * (cats[:, None] != cats[None]) if cat else 0)
        np.fill_diagonal(d, np.inf)
        for i in range(len(x)):
            best = np.lexsort((np.arange(len(x)), d[i]))[:5]
            assert [n for _, n in got[i]] == list(best)


def test_nearest_in_small_groups(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 1.0), (3, "b", 5.0)], "id long, g string, x double")
    got = {r["id"]: [n["id"] for n in r["neighbors"]] for r in nearest(df, "id", ["x"], 5, ["g"]).collect()}
    assert got == {1: [2], 2: [1], 3: []}


def test_smote_stays_between_neighbours(spark):
    rng = np.random.default_rng(3)
    minority = [(1, float(a), float(b), "u") for a, b in rng.uniform(0, 1, size=(40, 2))]
    copies = [(1, 0.5, 0.5, "w")] * 20
    majority = [(0, float(a), float(b), "v") for a, b in rng.uniform(5, 6, size=(200, 2))]
    df = spark.createDataFrame(minority + copies + majority, "y int, a double, b double, c string")
    out = resample.smote(df, "y", ["a", "b"], block=8)
    rows = out.collect()
    assert len(rows) == 140 and all(r["y"] == 1 and 0 <= r["a"] <= 1 and 0 <= r["b"] <= 1 for r in rows)
    again = sorted(map(tuple, resample.smote(df, "y", ["a", "b"], block=8).collect()))
    assert again == sorted(map(tuple, rows))
    nc = resample.smote(df, "y", ["a", "b", "c"], ["c"], block=8).collect()
    assert len(nc) == 140 and {r["c"] for r in nc} <= {"u", "w"}


def test_synthetic_rows_lie_on_segments_to_nearest_rows(spark):
    """Against brute force: each row is between a row of its class and one of that row's five nearest, copies counted."""
    rng = np.random.default_rng(5)
    minority = [(1, *map(float, p)) for p in rng.normal(size=(60, 3))] + [(1, 0.25, 0.25, 0.25)] * 4
    df = spark.createDataFrame(minority + [(0, *map(float, p)) for p in rng.normal(size=(150, 3)) + 9], "y int, a double, b double, c double")
    x = np.array([r[1:] for r in minority])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    pairs = [(i, j) for i in range(len(x)) for j in np.flatnonzero(d[i] <= np.sort(d[i])[4] + 1e-12)]
    starts, ends = x[[i for i, _ in pairs]], x[[j for _, j in pairs]]
    for r in resample.smote(df, "y", ["a", "b", "c"], block=8).collect():
        p = np.array([r.a, r.b, r.c])
        along = ends - starts
        t = np.clip(((p - starts) * along).sum(1) / np.maximum((along**2).sum(1), 1e-300), 0, 1)
        assert np.abs(starts + t[:, None] * along - p).max(1).min() < 1e-9


def test_nearest_with_many_axes(spark):
    """Fifty axes, several levels of boxes and copies: still the brute-force neighbours."""
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(250, 50)), rng.normal(size=(60, 50)) * 0.01 + 3, np.ones((10, 50))])
    axes = [f"x{j}" for j in range(50)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, " + ", ".join(f"{a} double" for a in axes))
    got = {r["id"]: [n["id"] for n in r["neighbors"]] for r in nearest(df, "id", axes, 4, block=4).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        assert np.allclose(np.sort(d[i])[:4], d[i][got[i]], atol=1e-9) and len(set(got[i])) == 4


def test_upsample_falls_back(spark):
    rows = [(0, float(i)) for i in range(30)] + [(1, 1.0), (1, 2.0)]
    df = spark.createDataFrame(rows, "y int, x double")
    out = resample.upsample(df, "y", ["x"], ["x"], "classification")
    assert {r["count"] for r in out.groupBy("y").count().collect()} == {30}
    assert {r["x"] for r in out.filter("y = 1").collect()} == {1.0, 2.0}
    assert resample.upsample(df, "y", ["x"], ["x"], "regression").count() == 32


def test_category_costs_move_no_rows(spark):
    """The deviations of a class are summed where its rows are: no join takes the rows of a large class to one task."""
    rng = np.random.default_rng(7)
    rows = [(int(i % 10 == 0), *map(float, p)) for i, p in enumerate(rng.normal(size=(500, 3)) * [1, 2, 3])]
    costs = resample._category_costs(spark.createDataFrame(rows, "y int, a double, b double, c double"), "y", ["a", "b", "c"])
    assert "Join" not in costs._jdf.queryExecution().optimizedPlan().toString()
    got = {r["y"]: r["_cost"] for r in costs.collect()}
    for y in (0, 1):
        assert np.isclose(got[y], np.median(np.std([r[1:] for r in rows if r[0] == y], axis=0)) ** 2)


def test_copies_are_made_by_several_tasks(spark):
    rows = [(0, float(i)) for i in range(2000)] + [(1, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "y int, x double")
    for out in (resample.smote(df, "y", ["x"]), resample.random_oversample(df, "y", ["y", "x"])):
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_nearest_among_copies(spark, monkeypatch):
    """Rows that repeat many times: the SQL answer, ties by key, and no more work than for the rows that differ."""
    rng = np.random.default_rng(13)
    spots = [("g", 0.0, 0.0, "u"), ("g", 0.0, 0.0, None), ("g", 3.0, 4.0, "u"), ("h", 1.0, 1.0, "v"), (None, 2.0, 2.0, "u")]
    rows = [(i, *spots[j]) for i, j in enumerate(rng.permutation([0] * 150 + [1] * 3 + [2] * 2 + [3] + [4] * 9))]
    df = spark.createDataFrame(rows, "id long, g string, a double, b double, c string")
    compared, find = [], neighbors._nearest_points
    monkeypatch.setattr(neighbors, "_nearest_points", lambda points, *rest: (compared.append(points.count()), find(points, *rest))[1])
    got = {r["id"]: [(n["distance"], n["id"]) for n in r["neighbors"]]
           for r in nearest(df.withColumn("cost", F.lit(4.0)), "id", ["a", "b"], 4, ["g"], ["c"], "cost", block=4).collect()}
    assert compared == [5] and len(got) == len(rows)
    for i, g, a, b, c in rows:
        others = sorted((float(np.sqrt((a - r[2]) ** 2 + (b - r[3]) ** 2 + 4.0 * (c != r[4]))), r[0]) for r in rows if r[0] != i and r[1] == g)
        assert got[i] == others[:4]


def test_discrete_quantiles_and_fine_cuts(hot, spark):
    """The value at rank ceil(p * rows), with hot values, groups, nulls and a column of nulls alone."""
    probs = [0.0, 0.001, 0.125, 0.5, 0.7, 0.9999, 1.0]
    df = hot.select("y", F.when(F.col("id") % 11 > 0, F.col("t")).cast("double").alias("t"), F.lit(None).cast("double").alias("none"))
    got = {r["y"]: r["edges"] for r in ranks.discrete_quantiles(df, "t", probs, ["y"]).collect()}
    rows = df.filter("t IS NOT NULL").collect()
    for y in {r["y"] for r in rows}:
        values = sorted(r["t"] for r in rows if r["y"] == y)
        assert got[y] == [values[max(1, int(np.ceil(p * len(values)))) - 1] for p in probs]
    exact = binning.numeric_cuts(df, ["t", "none"], 64, 10_000_000)
    assert exact == binning.numeric_cuts(df, ["t", "none"], 64, binning.SKETCH_ACCURACY) and exact["none"] == []
