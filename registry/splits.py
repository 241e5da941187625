"""Split and resampling queries, keyed by orders, events and customer."""

from pyspark.sql import functions as F

from glasswork.operators import resample as rs
from glasswork.operators import splits as ops
from glasswork.operators.neighbors import nearest
from registry.common import Registry, rounded, table

REG = Registry()
query = REG.query

HASH = "MD5('42|' || o_orderkey)"


def orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("kfold", f"SELECT o_orderkey, ('0x' || SUBSTR({HASH}, 1, 8))::BIGINT % 5 AS fold FROM orders")
def _(spark, sf):
    return ops.kfold(orders(spark, sf), ["o_orderkey"]).select("o_orderkey", "fold")


@query("stratified_kfold", f"""
SELECT o_orderkey, o_orderstatus, (ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY {HASH}) - 1) % 5 AS fold FROM orders""")
def _(spark, sf):
    out = ops.stratified_kfold(orders(spark, sf), "o_orderstatus", ["o_orderkey"])
    return out.select("o_orderkey", "o_orderstatus", "fold")


TS = "DATE_TRUNC('hour', ts)"
BLOCKS = f"""(SELECT event_id, CASE WHEN pos < n - 5 * (n // 6) THEN 0 ELSE (pos - (n - 5 * (n // 6))) // (n // 6) + 1 END AS block
  FROM (SELECT event_id, ROW_NUMBER() OVER (ORDER BY {TS}, MD5('42|' || event_id)) - 1 AS pos, COUNT(*) OVER () AS n FROM events))"""


def events(spark, sf):
    # Hours, so that many rows share a time.
    return table(spark, sf, "events").select("event_id", F.date_trunc("hour", "ts").alias("hour"))


@query("time_series_split", f"""
SELECT event_id, fold::INTEGER AS fold, CASE WHEN fold = block THEN 'test' ELSE 'train' END AS role
FROM {BLOCKS}, range(1, 6) AS f(fold) WHERE fold >= block""")
def _(spark, sf):
    return ops.time_series_split(events(spark, sf), "hour", ["event_id"]).select("event_id", "fold", "role")


@query("oot_holdout", f"""
SELECT event_id, ROW_NUMBER() OVER (ORDER BY {TS} DESC, MD5('42|' || event_id) DESC) <= 1000 AS is_oot FROM events""")
def _(spark, sf):
    return ops.oot_holdout(events(spark, sf), "hour", ["event_id"], 1000).select("event_id", "is_oot")


@query("trim_classes", f"""
SELECT o_orderkey, o_orderstatus FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY {HASH}) AS i FROM orders)
WHERE i <= 2500""")
def _(spark, sf):
    out = rs.trim_classes(orders(spark, sf), "o_orderstatus", ["o_orderkey"], 4, max_cells=10000)
    return out.select("o_orderkey", "o_orderstatus")


SKEWED = "(SELECT o_orderkey, CASE WHEN o_custkey % 10 < 7 THEN 'most' WHEN o_custkey % 10 = 7 THEN 'few' ELSE 'some' END AS y FROM orders)"


def skewed(spark, sf):
    digit = F.col("o_custkey") % 10
    return orders(spark, sf).withColumn("y", F.when(digit < 7, "most").when(digit == 7, "few").otherwise("some"))


@query("random_oversample", f"""
WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY y ORDER BY {HASH}) - 1 AS pos, COUNT(*) OVER (PARTITION BY y) AS n FROM {SKEWED}),
m AS (SELECT MAX(n) AS most FROM r)
SELECT o_orderkey, y, UNNEST(RANGE(most // n + CASE WHEN pos < most % n THEN 1 ELSE 0 END)) AS copy FROM r, m""")
def _(spark, sf):
    return rs.random_oversample(skewed(spark, sf), "y", ["o_orderkey"]).select("o_orderkey", "y", "copy")


@query("calibration_split", """
SELECT o_orderkey, ('0x' || SUBSTR(MD5('123|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0 < 0.2 AS is_calibration FROM orders""")
def _(spark, sf):
    return ops.calibration_split(orders(spark, sf), ["o_orderkey"]).select("o_orderkey", "is_calibration")


@query("nearest_neighbors", """
WITH c AS (SELECT c_custkey, c_mktsegment, c_acctbal AS a, c_nationkey * 400.0 AS b FROM customer),
d AS (SELECT x.c_mktsegment, x.c_custkey, y.c_custkey AS other, SQRT(POW(x.a - y.a, 2) + POW(x.b - y.b, 2)) AS dist
  FROM c AS x JOIN c AS y ON x.c_mktsegment = y.c_mktsegment AND x.c_custkey <> y.c_custkey),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY dist, other) AS i FROM d)
SELECT c_mktsegment, c_custkey, (i - 1)::INTEGER AS pos, ROUND(dist, 4) AS distance FROM r WHERE i <= 5""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment", F.col("c_acctbal").alias("a"), (F.col("c_nationkey") * 400.0).alias("b"))
    near = nearest(c, "c_custkey", ["a", "b"], 5, ["c_mktsegment"], block=32)
    out = near.select("c_mktsegment", "c_custkey", F.posexplode("neighbors").alias("pos", "nb"))
    return rounded(out.select("c_mktsegment", "c_custkey", "pos", F.col("nb.distance").alias("distance")), "distance", digits=4)


def returned(spark, sf):
    """Imbalanced lineitem rows: one class holds most of them."""
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_linestatus",
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") <= 2), 1).otherwise(0).alias("y"))


@query("smote")
def _(spark, sf):
    return rs.smote(returned(spark, sf), "y", ["l_quantity", "l_discount", "l_tax"])


@query("smote_nc")
def _(spark, sf):
    return rs.smote(returned(spark, sf), "y", ["l_quantity", "l_discount", "l_tax", "l_linestatus"], ["l_linestatus"])


def invariants(rows, synthetic, numbers, categories=()):
    """Per class the synthetic rows and how many lie inside the box and the categories of the class's own rows."""
    box = rows.groupBy("y").agg(*[f(c).alias(f"{n}_{c}") for c in numbers for n, f in (("lo", F.min), ("hi", F.max))],
                                *[F.collect_set(c).alias(f"all_{c}") for c in categories])
    ok = F.lit(True)
    for c in numbers:
        ok = ok & F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    for c in categories:
        ok = ok & F.array_contains(f"all_{c}", F.col(c))
    return synthetic.join(F.broadcast(box), "y").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("inside"))


INVARIANT_SQL = """WITH c AS (SELECT (l_returnflag = 'R' AND l_linenumber <= 2)::INTEGER AS y, COUNT(*) AS n FROM lineitem GROUP BY 1)
SELECT y, (SELECT MAX(n) FROM c) - n AS n, (SELECT MAX(n) FROM c) - n AS inside FROM c WHERE n < (SELECT MAX(n) FROM c)"""


@query("smote_invariants", INVARIANT_SQL)
def _(spark, sf):
    numbers = ["l_quantity", "l_discount", "l_tax"]
    rows = returned(spark, sf)
    return invariants(rows, rs.smote(rows, "y", numbers), numbers)


@query("smote_nc_invariants", INVARIANT_SQL)
def _(spark, sf):
    numbers = ["l_quantity", "l_discount", "l_tax"]
    rows = returned(spark, sf)
    return invariants(rows, rs.smote(rows, "y", [*numbers, "l_linestatus"], ["l_linestatus"]), numbers, ["l_linestatus"])


@query("upsample", """
SELECT y, (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_returnflag = 'R' AND l_linenumber <= 2)) AS n
FROM (VALUES (0), (1)) AS v(y)""")
def _(spark, sf):
    features = ["l_quantity", "l_discount", "l_tax", "l_linestatus"]
    out = rs.upsample(returned(spark, sf), "y", features, features, "classification")
    return out.groupBy("y").agg(F.count("*").alias("n"))
