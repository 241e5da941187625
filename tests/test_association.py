import math

import pytest
from pyspark.sql import functions as F

from glasswork.operators import association as a


def test_corrected_v_of_a_known_table(spark):
    """Three by three, worked out by hand: phi squared less its bias, over the smaller corrected side."""
    table = {("low", "x"): 30, ("low", "y"): 4, ("low", "z"): 6, ("mid", "x"): 3, ("mid", "y"): 25, ("mid", "z"): 7,
             ("top", "x"): 2, ("top", "y"): 6, ("top", "z"): 40}
    cells = spark.createDataFrame([(p, q, n) for (p, q), n in table.items()], "va string, vb string, n long")
    total = sum(table.values())
    rows = {p: sum(n for (x, _), n in table.items() if x == p) for p, _ in table}
    cols = {q: sum(n for (_, y), n in table.items() if y == q) for _, q in table}
    phi = sum((n - rows[p] * cols[q] / total) ** 2 / (rows[p] * cols[q] / total) for (p, q), n in table.items()) / total
    side = 3 - 4 / (total - 1)
    want = math.sqrt(max(0.0, phi - 4 / (total - 1)) / (side - 1))
    assert a.corrected_v(a.chi2(cells), ()).first()["value"] == pytest.approx(want, abs=1e-12)


def test_xi_of_a_parabola(spark):
    """y is a function of x but not monotone: xi is large, and equals its definition."""
    points = [(k, (k - 20) * (k - 20) * 41 + k) for k in range(41)]
    df = spark.createDataFrame(points, "x long, y long")
    ys = [y for _, y in points]
    rank = {y: i + 1 for i, y in enumerate(sorted(ys))}
    n = len(ys)
    want = 1 - 3 * sum(abs(rank[p] - rank[q]) for p, q in zip(ys, ys[1:])) / (n * n - 1)
    assert a.xi(df, "x", "y", ties=False).first()["value"] == pytest.approx(want, abs=1e-12)
    assert want > 0.8


def test_xi_with_one_hot_value(spark):
    """Two thirds of x share a value: the hot value is split by hash and the result stays exact."""
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(25).alias("x"),
                                  (F.col("id") * 7919 % 101).alias("y"))
    rows = [tuple(r) for r in df.withColumn("h", F.md5(F.concat(F.lit("42|"), F.col("id").cast("string")))).select("x", "h", "y").collect()]
    ys = [y for _, _, y in sorted(rows)]
    n = len(ys)
    at_most = {v: sum(y <= v for y in ys) for v in set(ys)}
    at_least = {v: sum(y >= v for y in ys) for v in set(ys)}
    want = 1 - n * sum(abs(at_most[p] - at_most[q]) for p, q in zip(ys, ys[1:])) / (
        2 * sum(at_least[y] * (n - at_least[y]) for y in ys))
    assert a.xi(df, "x", "y", ["id"]).first()["value"] == pytest.approx(want, abs=1e-12)


def test_matrices_hold_every_pair(spark):
    rows = [(k, -2.0 * k, k * k % 7, "even" if k % 2 == 0 else "odd", "abc"[k % 3]) for k in range(30)]
    df = spark.createDataFrame(rows, "up long, down double, wave long, parity string, third string")
    m = {(r["a"], r["b"]): r["value"] for r in a.correlation_matrix(df.select("up", "down", "wave"), "pearson").collect()}
    assert len(m) == 9 and m["up", "down"] == pytest.approx(-1.0) and m["wave", "wave"] == pytest.approx(1.0)
    assert m["up", "wave"] == pytest.approx(df.stat.corr("up", "wave"))
    v = {(r["a"], r["b"]): r["value"] for r in a.correlation_matrix(df.select("parity", "third"), "cramerv").collect()}
    # Thirty rows in a balanced two by three table: independent, so zero.
    assert v == {("parity", "parity"): 1.0, ("third", "third"): 1.0, ("parity", "third"): 0.0, ("third", "parity"): 0.0}
    with pytest.raises(ValueError):
        a.correlation_matrix(df, "unknown")


def test_undefined_cells_are_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", "k"), (1.0, 3.0, "b", "k")], "c double, d double, s string, t string")
    got = {(r["kind"], r["a"], r["b"]): r["value"] for r in a.association(df).collect()}
    assert got["pearson", "c", "d"] == 0.0 and got["cramerv", "s", "t"] == 0.0
    assert got["xi", "d", "c"] == 0.0
    assert a.association(df.select("s")) is None
