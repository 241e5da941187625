"""Profiling queries: reads, target checks, null counts, type and task inference, feature selection."""

from pyspark.sql import functions as F

from glasswork.operators import profile as ops
from glasswork.sources.tables import DEFAULT_NULLS, TRAIN_NULLS, nullify, sample_scan
from registry.common import Registry, rounded, table

REG = Registry()
query = REG.query

# Null tokens spread over customer names, as a CSV reader would meet them.
TOKEN_SQL = """CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN 'NULL' WHEN 3 THEN 'nan'
  WHEN 4 THEN 'None' ELSE c_name END"""


def tokens(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.expr(TOKEN_SQL).alias("name"))


@query("read_null_tokens", f"""
SELECT c_custkey, CASE WHEN name NOT IN ('', 'N/A', 'NULL', 'None', 'NONE') THEN name END AS name
FROM (SELECT c_custkey, {TOKEN_SQL} AS name FROM customer)""")
def _(spark, sf):
    return nullify(tokens(spark, sf), TRAIN_NULLS)


@query("read_default_null_tokens", f"""
SELECT c_custkey, CASE WHEN name NOT IN ('', 'N/A', 'NULL', 'None', 'nan') THEN name END AS name
FROM (SELECT c_custkey, {TOKEN_SQL} AS name FROM customer)""")
def _(spark, sf):
    return nullify(tokens(spark, sf), DEFAULT_NULLS)


@query("sample_scan", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE ('0x' || SUBSTR(MD5('42|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0
  < (SELECT CASE WHEN COUNT(*) * 0.05 >= 500 THEN 0.05 ELSE 0.5 END FROM orders)""")
def _(spark, sf):
    return sample_scan(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("check_target", """
SELECT 'binary' AS name, COUNT(DISTINCT y) AS distinct_values, MIN(y)::VARCHAR AS lo, MAX(y)::VARCHAR AS hi, 'ok' AS verdict
  FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)
UNION ALL SELECT 'text', COUNT(DISTINCT l_linestatus), MIN(l_linestatus), MAX(l_linestatus), 'not_0_1' FROM lineitem
UNION ALL SELECT 'constant', COUNT(DISTINCT y), MIN(y)::VARCHAR, MAX(y)::VARCHAR, 'constant'
  FROM (SELECT CASE WHEN l_partkey % 7 <> 0 THEN 1 END AS y FROM lineitem)
UNION ALL SELECT 'many', COUNT(DISTINCT l_linenumber), MIN(l_linenumber)::VARCHAR, MAX(l_linenumber)::VARCHAR, 'ok' FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("binary"), F.col("l_linestatus").alias("text"),
        F.when(F.col("l_partkey") % 7 != 0, 1).alias("constant"), F.col("l_linenumber").alias("many"))
    parts = [ops.check_target(li, c).select(F.lit(c).alias("name"), "*") for c in li.columns]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("null_counts", """
SELECT 'l_quantity' AS "column", COUNT(*) AS nulls FROM lineitem WHERE l_partkey % 7 = 0
UNION ALL SELECT 'l_linestatus', COUNT(*) FROM lineitem WHERE l_suppkey % 7 = 0""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({
        "l_quantity": F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")),
        "l_linestatus": F.when(F.col("l_suppkey") % 7 != 0, F.col("l_linestatus"))})
    return ops.null_counts(li, ["l_quantity", "l_linestatus", "l_tax", "l_discount"])


@query("infer_task", """
SELECT target, CASE WHEN kind = 'float' OR (kind = 'int' AND n > 10) THEN 'regression' ELSE 'classification' END AS task FROM (
  SELECT 'l_linenumber' AS target, 'int' AS kind, COUNT(DISTINCT l_linenumber) AS n FROM lineitem
  UNION ALL SELECT 'l_partkey', 'int', COUNT(DISTINCT l_partkey) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'float', COUNT(DISTINCT l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_returnflag', 'text', COUNT(DISTINCT l_returnflag) FROM lineitem)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    targets = ["l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag"]
    return spark.createDataFrame([(t, ops.infer_task(li, t)) for t in targets], "target string, task string")


ORDER_COLS = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "float",
              "o_orderdate": "time", "o_orderpriority": "text", "padded": "int", "clerk": "text", "one": "int",
              "shipped": "time", "year": "text", "day": "date_text"}
ORDERS_SQL = """(SELECT *, 100000000 + o_orderkey // 1 - CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END AS padded,
  'Clerk ' || (o_orderkey // 2) AS clerk, 1 AS one, o_orderdate AS shipped, STRFTIME(o_orderdate, '%Y') AS year,
  STRFTIME(o_orderdate, '%Y-%m-%d') AS day FROM orders)"""


def _order_columns(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.withColumns({
        "padded": (F.lit(100000000).cast("bigint") + key - F.when(key % 50 == 1, 1).otherwise(0)),
        "clerk": F.concat(F.lit("Clerk "), F.floor(key / 2).cast("string")), "one": F.lit(1),
        "shipped": F.col("o_orderdate"), "year": F.date_format("o_orderdate", "yyyy"),
        "day": F.date_format("o_orderdate", "yyyy-MM-dd")})


def _profile_sql(kind, col):
    return (f"SELECT '{col}' AS \"column\", '{kind}' AS kind, COUNT(*) AS n, COUNT(DISTINCT {col}) AS d, "
            f"COUNT(DISTINCT LENGTH({col}::VARCHAR)) AS lens FROM {ORDERS_SQL}")


@query("feature_reasons", f"""
SELECT "column", CASE WHEN d = n AND kind <> 'float' THEN 'unique'
  WHEN d / n > 0.9 AND kind = 'int' AND lens = 1 THEN 'high_cardinality_int'
  WHEN "column" LIKE '%date%' OR "column" LIKE '%dt%' THEN 'date_name'
  WHEN d / n > 0.4 AND kind IN ('text', 'date_text') THEN 'high_cardinality_text'
  WHEN d = 1 THEN 'constant' WHEN kind = 'time' THEN 'type_timestamp_ntz'
  WHEN kind = 'date_text' THEN 'type_timestamp' END AS reason
FROM ({' UNION ALL '.join(_profile_sql(k, c) for c, k in ORDER_COLS.items())})""")
def _(spark, sf):
    return ops.feature_reasons(_order_columns(spark, sf), list(ORDER_COLS))


@query("distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT(*) AS n_rows, COUNT(DISTINCT {c}) AS n_distinct FROM lineitem"
    for c in ("l_quantity", "l_discount", "l_returnflag", "l_partkey", "l_shipdate")))
def _(spark, sf):
    cols = ["l_quantity", "l_discount", "l_returnflag", "l_partkey", "l_shipdate"]
    return ops.distinct_counts(table(spark, sf, "lineitem"), cols).select("column", "n_rows", "n_distinct")


@query("infer_types", """
SELECT UNNEST(['price', 'year', 'day', 'flag', 'name']) AS "column",
  UNNEST([CASE WHEN BOOL_AND(TRY_CAST(o_totalprice::VARCHAR AS DOUBLE) IS NOT NULL) THEN 'double' END,
          CASE WHEN BOOL_AND(TRY_CAST(STRFTIME(o_orderdate, '%Y') AS BIGINT) IS NOT NULL) THEN 'bigint' END,
          CASE WHEN BOOL_AND(TRY_CAST(STRFTIME(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) IS NOT NULL) THEN 'timestamp' END,
          'boolean', CASE WHEN NOT BOOL_AND(TRY_CAST(o_orderpriority AS DOUBLE) IS NOT NULL) THEN 'string' END]) AS inferred
FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy").alias("year"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("o_custkey") % 2 == 0, "True").otherwise("false").alias("flag"), F.col("o_orderpriority").alias("name"))
    return spark.createDataFrame(list(ops.infer_types(o).items()), "`column` string, inferred string")


FOLD_SQL = "('0x' || SUBSTR(MD5('42|' || o_orderkey), 1, 8))::BIGINT % 5"


@query("fold_report", f"""
SELECT ({FOLD_SQL})::BIGINT AS fold, COUNT(*) AS n, ROUND(AVG(o_totalprice), 4) AS mean,
  ROUND(STDDEV_POP(o_totalprice), 4) AS std FROM orders GROUP BY 1""")
def _(spark, sf):
    from glasswork.operators.splits import kfold

    out = ops.fold_report(kfold(table(spark, sf, "orders"), ["o_orderkey"]), "o_totalprice")
    return rounded(out, "mean", "std", digits=4)


@query("fold_report_classes", f"""
SELECT ({FOLD_SQL})::BIGINT AS fold, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    from glasswork.operators.splits import kfold

    return ops.fold_report(kfold(table(spark, sf, "orders"), ["o_orderkey"]), "o_orderstatus")
