"""Lookup-table queries: one small model per supplier, and runs of equal values over events."""

from pyspark.sql import functions as F

from glasswork.functions.hashing import row_hash
from glasswork.operators import lookup as ops
from glasswork.operators.ranks import island_ids
from registry.common import Registry, table

REG = Registry()
query = REG.query

CELLS_SQL = """(SELECT l_suppkey AS model_id, FLOOR(l_quantity / 5)::INTEGER AS position,
  CASE WHEN FLOOR(l_quantity / 5) > 0 THEN FLOOR(l_quantity / 5) * 5 END AS bound, NULL::VARCHAR AS category, 'numeric' AS kind,
  ((COUNT(*) % 3) * 0.25)::DOUBLE AS score, MIN(l_tax) AS lower, MAX(l_extendedprice) AS upper
FROM lineitem GROUP BY ALL)"""


def cells(spark, sf):
    """A numeric term per supplier: ten quantity bins scored by their row counts."""
    bin_no = F.floor(F.col("l_quantity") / 5)
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("model_id"), bin_no.cast("int").alias("position"),
    ).agg((F.count("*") % 3 * F.lit(0.25)).alias("score"), F.min("l_tax").alias("lower"),
          F.max("l_extendedprice").alias("upper")).select(
        "model_id", "position", F.when(F.col("position") > 0, F.col("position") * F.lit(5.0)).alias("bound"),
        F.lit(None).cast("string").alias("category"), F.lit("numeric").alias("kind"), "score", "lower", "upper")


@query("explode_lookup", f"SELECT model_id, position, bound, score FROM {CELLS_SQL}")
def _(spark, sf):
    ordered = F.sort_array(F.collect_list(F.struct("position", "bound", "score")))
    lists = cells(spark, sf).groupBy("model_id").agg(ordered.alias("s")).select(
        "model_id", F.col("s.bound").alias("bound"), F.col("s.score").alias("score"), F.col("s.position").alias("p"))
    # Suppliers without some bin keep the bin's own number.
    out = ops.explode_lookup(lists, ["model_id"], ["p", "bound", "score"])
    return out.select("model_id", F.col("p").alias("position"), "bound", "score")


@query("merge_runs", f"""
WITH f AS (SELECT *, CASE WHEN LAG(score) OVER w IS NOT DISTINCT FROM score AND LAG(bound) OVER w IS NOT NULL
    AND bound IS NOT NULL THEN 0 ELSE 1 END AS changed FROM {CELLS_SQL} WINDOW w AS (PARTITION BY model_id ORDER BY position)),
g AS (SELECT *, SUM(changed) OVER (PARTITION BY model_id ORDER BY position) AS island FROM f)
SELECT model_id, kind, MAX(position) AS position, ARG_MAX(bound, position) AS bound, NULL::VARCHAR AS category,
  ANY_VALUE(score) AS score, ARG_MIN(lower, position) AS lower, ARG_MAX(upper, position) AS upper
FROM g GROUP BY model_id, kind, island""")
def _(spark, sf):
    return ops.merge_runs(cells(spark, sf), ["model_id"])


@query("island_ids", """
WITH f AS (SELECT user_id, event_id, event_type, ts, CASE WHEN event_type IS DISTINCT FROM
    LAG(event_type) OVER w AND ROW_NUMBER() OVER w > 1 THEN 1 ELSE 0 END AS changed
  FROM (SELECT user_id % 3 AS user_id, event_id, event_type, DATE_TRUNC('minute', ts) AS ts FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, MD5('42|' || event_id)))
SELECT user_id, event_id, SUM(changed) OVER (PARTITION BY user_id ORDER BY ts, MD5('42|' || event_id))::BIGINT AS island FROM f""")
def _(spark, sf):
    ev = table(spark, sf, "events").select(
        (F.col("user_id") % 3).alias("user_id"), "event_id", "event_type", F.date_trunc("minute", "ts").alias("ts"))
    out = island_ids(ev, "ts", F.col("event_type"), ["user_id"], row_hash(["event_id"]))
    return out.select("user_id", "event_id", "island")


# Two axes per model: quantity (five bins, the first one missing) by tax (three bins, the last one open).
PAIR_CELLS_SQL = """(SELECT l_suppkey % 20 AS model_id, a AS pos_1, b AS pos_2, CASE WHEN a > 0 THEN a * 12.0 END::DOUBLE AS bound_1,
  CASE WHEN b = 2 THEN 'Infinity'::DOUBLE ELSE b * 0.03 END::DOUBLE AS bound_2, ((COUNT(*) % 3) * 0.25)::DOUBLE AS score FROM (
  SELECT *, LEAST(FLOOR(l_quantity / 12), 4)::INTEGER AS a, LEAST(FLOOR(l_tax * 100 / 3), 2)::INTEGER AS b FROM lineitem) GROUP BY 1, 2, 3)"""


def pair_cells(spark, sf):
    first = F.least(F.floor(F.col("l_quantity") / 12), F.lit(4)).cast("int")
    second = F.least(F.floor(F.col("l_tax") * 100 / 3), F.lit(2)).cast("int")
    return table(spark, sf, "lineitem").groupBy(
        (F.col("l_suppkey") % 20).alias("model_id"), first.alias("pos_1"), second.alias("pos_2"),
    ).agg((F.count("*") % 3 * F.lit(0.25)).alias("score")).select(
        "model_id", "pos_1", "pos_2", F.when(F.col("pos_1") > 0, F.col("pos_1") * F.lit(12.0)).alias("bound_1"),
        F.when(F.col("pos_2") == 2, float("inf")).otherwise(F.col("pos_2") * F.lit(0.03)).alias("bound_2"), "score")


def grids(spark, sf):
    """The same cells as list-valued rows, one per model."""
    rows = pair_cells(spark, sf).groupBy("model_id", "pos_1", "bound_1").agg(
        F.sort_array(F.collect_list(F.struct("pos_2", "bound_2", "score"))).alias("r"))
    all_ = rows.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("pos_1", "bound_1", "r"))).alias("g"))
    return all_.select(
        "model_id", F.lit("l_quantity").alias("feat_1"), F.lit("l_tax").alias("feat_2"), F.lit("numeric").alias("type_1"),
        F.lit("numeric").alias("type_2"), F.transform("g", lambda s: s["bound_1"]).alias("bound_1"),
        F.transform(F.get(F.transform("g", lambda s: s["r"]), F.lit(0)), lambda s: s["bound_2"]).alias("bound_2"),
        F.transform("g", lambda s: F.transform(s["r"], lambda t: t["score"])).alias("scores"))


@query("orient_pairs", f"""
SELECT model_id, 'l_tax' AS feat_1, pos_2 AS pos_1, pos_1 AS pos_2, bound_2 AS bound_1, bound_1 AS bound_2, score FROM {PAIR_CELLS_SQL}""")
def _(spark, sf):
    return ops.explode_pairs(ops.orient_pairs(grids(spark, sf)), ["model_id", "feat_1"])


@query("explode_pairs", f"SELECT model_id, feat_1, pos_1, pos_2, bound_1, bound_2, score FROM (SELECT *, 'l_quantity' AS feat_1 FROM {PAIR_CELLS_SQL})")
def _(spark, sf):
    return ops.explode_pairs(grids(spark, sf), ["model_id", "feat_1"])


MERGED_SQL = f"""(WITH f AS (SELECT *, CASE WHEN LAG(score) OVER w IS NOT DISTINCT FROM score AND bound_2 <> 'Infinity'::DOUBLE
  THEN 0 ELSE 1 END AS changed FROM {PAIR_CELLS_SQL} WINDOW w AS (PARTITION BY model_id, pos_1 ORDER BY pos_2)),
g AS (SELECT *, SUM(changed) OVER (PARTITION BY model_id, pos_1 ORDER BY pos_2) AS island FROM f)
SELECT model_id, pos_1, ANY_VALUE(bound_1) AS bound_1, MAX(pos_2) AS pos_2, ARG_MAX(bound_2, pos_2) AS bound_2,
  ANY_VALUE(score) AS score FROM g GROUP BY model_id, pos_1, island)"""


@query("merge_pair_runs", f"SELECT * FROM {MERGED_SQL}")
def _(spark, sf):
    return ops.merge_pair_runs(pair_cells(spark, sf), ["model_id"])


@query("nest_pairs", f"""
SELECT model_id, pos_1, bound_1, ARRAY_TO_STRING(LIST(bound_2::VARCHAR ORDER BY pos_2), ' ') AS bounds_2,
  ARRAY_TO_STRING(LIST(score::VARCHAR ORDER BY pos_2), ' ') AS scores FROM {MERGED_SQL} GROUP BY 1, 2, 3""")
def _(spark, sf):
    out = ops.nest_pairs(ops.merge_pair_runs(pair_cells(spark, sf), ["model_id"]), ["model_id"])

    def text(c):
        return F.replace(F.array_join(F.transform(c, lambda x: x.cast("string")), " "), F.lit("Infinity"), F.lit("inf"))

    return out.select("model_id", "pos_1", "bound_1", text("bounds_2").alias("bounds_2"), text("scores").alias("scores"))


@query("round_scores", """
SELECT l_suppkey, ROUND(AVG(l_discount), 3) AS score FROM lineitem GROUP BY 1""")
def _(spark, sf):
    means = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("score"))
    return ops.round_scores(means, 3)


@query("attach_scores", f"""
SELECT c.model_id, c.position, s.brand_score FROM {CELLS_SQL} AS c LEFT JOIN
  (SELECT s_suppkey + 3 AS model_id, s_acctbal AS brand_score FROM supplier) AS s USING (model_id)""")
def _(spark, sf):
    """The side's ids are shifted, so some cells have no score and some scores no cell."""
    side = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 3).alias("model_id"), F.col("s_acctbal").alias("brand_score"))
    return ops.attach_scores(cells(spark, sf).select("model_id", "position"), side, "model_id")
