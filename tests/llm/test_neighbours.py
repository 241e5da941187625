"""Neighbour graph and walks against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glasswork.llm import neighbour_graph as ng, queries

SCHEMA = "vec_id long, embedding array<float>, id string, node string, v int"


def exact(rows, query, k):
    own = np.array(query[1], float)
    near = {}
    for i, v in rows:
        if i != query[0]:
            d = math.sqrt(sum((float(a) - float(b)) ** 2 for a, b in zip(np.float32(own), np.float32(v))))
            near[i] = min(d, near.get(i, d))
    return sorted((d, i) for i, d in near.items())[:k]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], SCHEMA)


def test_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    points = [(i, [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(1, 160)]
    points = [(i, v if any(v) else [1.0, 0.0, 0.0]) for i, v in points]
    hot = [(200 + i, [2.0, 2.0, 2.0]) for i in range(80)]
    good = points + hot
    odd = [(500, None), (501, [0.0, 0.0, 0.0]), (502, [1.0, None, 2.0]), (503, [float("nan"), 1.0, 1.0]),
           (504, [float("inf"), 1.0, 1.0]), (505, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), points[0], points[0], hot[3]]
    got = ng.nearest(frame(spark, good + odd), F.col("id") % 20 == 0, k=10).collect()
    asked = [p for p in good if p[0] % 20 == 0]
    assert {r.query_id for r in got} == {p[0] for p in asked}
    for q in asked:
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q[0])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [(round(s, 9), i) for _, i, s in mine] == [(round(d, 9), i) for d, i in exact(good, q, 10)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(100, [1.0, 2.0])], [(100, [1.0, 2.0]), (200, [1.0, 2.0])]])
def test_few_rows(spark, rows):
    got = ng.nearest(frame(spark, rows), F.col("id") % 100 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got)] == (
        [(100, 1, 200, 0.0), (200, 1, 100, 0.0)] if len(rows) == 2 else [])


def test_recall_of_the_query(spark):
    """At least nine of ten true neighbours, with the exact distance."""
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op4_nearest_neighbours(spark, sf).collect()
    asked = [r for r in rows if r[0] % 100 == 0]
    found = 0
    for q in asked:
        want = dict((i, d) for d, i in exact(rows, q, 10))
        mine = [r for r in got if r.query_id == q[0]]
        assert len(mine) == 10
        found += sum(r.vec_id in want for r in mine)
        assert all(abs(r.score - want[r.vec_id]) < 1e-9 for r in mine if r.vec_id in want)
    assert found >= 9 * len(asked)


def test_graph_improves_with_rounds(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(20, 16)) * 4
    points = centre[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16))
    nodes = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "node long, v array<double>")
    d = ((points[:, None] - points[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    true = np.argsort(d, 1)[:, :10]

    def recall(rounds):
        _, graph = ng.build_graph(nodes, 20, rounds=rounds)
        lists = {}
        for r in graph.collect():
            lists.setdefault(r.src, set()).add(r.dst)
        return np.mean([len(lists.get(i, set()) & set(t)) / 10 for i, t in enumerate(true.tolist())])

    assert recall(3) > max(0.95, recall(0))


def test_recall_on_many_tight_clusters(spark):
    """Far more clusters than entry points, each larger than a node's list: the walks must start near their queries."""
    rng = np.random.default_rng(7)
    points = (np.repeat(rng.normal(size=(200, 64)) * 10, 50, 0) + rng.normal(size=(10_000, 64)) * 0.01).astype(np.float32)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    got = ng.nearest(frame(spark, rows), F.col("id") % 100 == 0).collect()
    found = 0
    for q in range(0, 10_000, 100):
        d = ((points.astype(float) - points[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        true = set(np.argsort(d)[:10].tolist())
        mine = {r.vec_id for r in got if r.query_id == q}
        assert len(mine) == 10
        found += len(mine & true)
    assert found >= 900, found


def test_hoods_give_only_what_improves_a_list():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 8)).astype("<f4")
    reach = [None if i % 3 == 0 else float(r) for i, r in enumerate(rng.uniform(4, 20, 30))]
    table = pa.table({"hood": [1] * 20 + [2] * 10, "node": list(range(30)), "vec": [v.tobytes() for v in x],
                      "reach": pa.array(reach, pa.float32())})
    got = {(r["src"], r["dst"]) for r in ng._nearest_of_all(table, 2).to_pylist()}
    assert got == {(a, b) for a in range(30) for b in range(30) if a != b and (a < 20) == (b < 20)
                   and (reach[a] is None or ((x[a] - x[b]) ** 2).sum() < reach[a])}


def test_entry_points_do_not_grow_with_the_table(spark):
    queries_ = spark.range(3).withColumnRenamed("id", "query")
    for n in (1_000, 40_000):
        nodes = spark.range(n).withColumnRenamed("id", "node")
        per = ng.starts(queries_, nodes, n).groupBy("query").count().collect()
        assert len(per) == 3 and all(10 <= r["count"] <= 70 for r in per)
