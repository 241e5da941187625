"""Cleaning queries over messy strings derived from customer, orders, part and supplier."""

from pyspark.sql import functions as F

from glasswork.operators import clean as ops
from registry.common import Registry, r6, table

REG = Registry()
query = REG.query

# The same expressions run in both engines.
MESSY = {
    "grouped": "concat(cast(c_custkey % 900 + 100 as varchar(9)), ' ', '123')",
    "nothing": "case c_custkey % 4 when 0 then 'None' when 1 then 'null' when 2 then 'NaN' else c_name end",
    "mixed": "case when c_custkey % 3 = 0 then c_mktsegment else cast(c_custkey as varchar(20)) end",
    "flag": "case c_custkey % 5 when 0 then 'True' when 1 then 'false' when 2 then 'False' when 3 then 'true' end",
    "money": "case when c_custkey % 6 <> 0 then concat('$ ', cast(c_custkey % 99 + 1 as varchar(9)), ',250.75USD') end",
}
MESSY_SQL = "(SELECT c_custkey, " + ", ".join(f"{e} AS {n}" for n, e in MESSY.items()) + """,
  ((DATE '2020-01-01' + (c_custkey * 11 % 700)::INTEGER)::DATE)::VARCHAR AS day FROM customer) AS m"""


def messy(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", *[F.expr(e).cast("string").alias(n) for n, e in MESSY.items()],
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") * 11 % 700).cast("int")).cast("string").alias("day"))


@query("parse_spaced_numbers", f"SELECT c_custkey, REPLACE(grouped, ' ', '')::DOUBLE AS grouped_numeric FROM {MESSY_SQL}")
def _(spark, sf):
    df = messy(spark, sf)
    cols = [c for c, flags in ops.detect(df).items() if flags["spaced"]]
    return ops.parse_spaced_numbers(df, cols).select("c_custkey", "grouped_numeric")


@query("null_strings", f"""
SELECT c_custkey, CASE WHEN LOWER(nothing) NOT IN ('nan', 'null', 'none') THEN nothing END AS nothing FROM {MESSY_SQL}""")
def _(spark, sf):
    return ops.null_strings(messy(spark, sf), ["nothing"]).select("c_custkey", "nothing")


@query("split_mixed", f"""
SELECT c_custkey, mixed, TRY_CAST(mixed AS DOUBLE) AS mixed_numeric,
  CASE WHEN TRY_CAST(mixed AS DOUBLE) IS NULL THEN mixed END AS mixed_non_numeric FROM {MESSY_SQL}""")
def _(spark, sf):
    df = messy(spark, sf).select("c_custkey", "mixed")
    cols = [c for c, flags in ops.detect(df).items() if flags["mixed"]]
    return ops.split_mixed(df, cols)


@query("parse_booleans", f"SELECT c_custkey, LOWER(flag) = 'true' AS flag_boolean FROM {MESSY_SQL}")
def _(spark, sf):
    return ops.parse_booleans(messy(spark, sf), ["flag"]).select("c_custkey", "flag_boolean")


@query("split_money", f"""
SELECT c_custkey, CASE WHEN money IS NOT NULL THEN (c_custkey % 99 + 1) * 1000 + 250.75 END::DOUBLE AS money_amount,
  CASE WHEN money IS NOT NULL THEN 'USD' END AS money_currency FROM {MESSY_SQL}""")
def _(spark, sf):
    return ops.split_money(messy(spark, sf).select("c_custkey", "money"), ["money"])


@query("expand_dates", f"""
SELECT c_custkey, day::TIMESTAMP AS day_datetime, YEAR(day::DATE)::INTEGER AS day_year, MONTH(day::DATE)::INTEGER AS day_month,
  DAY(day::DATE)::INTEGER AS day_day, DAYNAME(day::DATE) AS day_dayofweek, (ISODOW(day::DATE) - 1)::INTEGER AS day_dayofweek_int
FROM {MESSY_SQL}""")
def _(spark, sf):
    out = ops.expand_dates(messy(spark, sf).select("c_custkey", "day"), ["day"])
    return out.withColumn("day_datetime", F.col("day_datetime").cast("timestamp_ntz"))


@query("cyclic_encode", f"""
SELECT c_custkey, ROUND(SIN(2 * PI() * MONTH(day::DATE) / 12), 6) + 0.0 AS day_month_sin,
  ROUND(COS(2 * PI() * MONTH(day::DATE) / 12), 6) + 0.0 AS day_month_cos,
  ROUND(SIN(2 * PI() * (ISODOW(day::DATE) - 1) / 7), 6) + 0.0 AS day_dayofweek_sin,
  ROUND(COS(2 * PI() * (ISODOW(day::DATE) - 1) / 7), 6) + 0.0 AS day_dayofweek_cos FROM {MESSY_SQL}""")
def _(spark, sf):
    out = ops.cyclic_encode(ops.expand_dates(messy(spark, sf).select("c_custkey", "day"), ["day"]), ["day"])
    names = [f"day_{p}_{f}" for p in ("month", "dayofweek") for f in ("sin", "cos")]
    return out.select("c_custkey", *[(r6(n) + F.lit(0.0)).alias(n) for n in names])


DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@query("one_hot", f"SELECT c_custkey, " + ", ".join(
    [f"MONTH(day::DATE) = {m} AS day_month_{m}" for m in range(1, 13)]
    + [f"DAYNAME(day::DATE) = '{d}' AS day_dayofweek_{d}" for d in DAYS]) + f" FROM {MESSY_SQL}")
def _(spark, sf):
    dates = ops.expand_dates(messy(spark, sf).select("c_custkey", "day"), ["day"])
    return ops.one_hot(dates.select("c_custkey", "day_month", "day_dayofweek"), ["day_month", "day_dayofweek"])


HOLES = """(SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE p_size END AS sparse,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS kind, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1 END AS one,
  CASE WHEN p_partkey = 5 THEN 'single' WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS brand,
  CASE p_partkey % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'False' END AS flag, p_size > 25 AS big, p_retailprice FROM part)"""


def holes(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", F.when(~((key % 2 == 0) | (key % 7 == 0)), F.col("p_size")).alias("sparse"),
        F.when(key % 7 != 0, F.col("p_type")).alias("kind"), F.when(key % 3 != 0, 1).alias("one"),
        F.when(key == 5, "single").when(key % 11 != 0, F.col("p_brand")).alias("brand"),
        F.when(key % 3 == 0, "True").when(key % 3 == 1, "False").alias("flag"),
        (F.col("p_size") > 25).alias("big"), "p_retailprice")


FEATURES = ["sparse", "kind", "one", "flag", "big", "p_retailprice"]


@query("drop_sparse_columns", f"SELECT p_partkey, kind, one, brand, flag, big, p_retailprice FROM {HOLES}")
def _(spark, sf):
    return ops.drop_sparse_columns(holes(spark, sf))


@query("drop_null_target", f"SELECT p_partkey, brand FROM {HOLES} WHERE brand IS NOT NULL")
def _(spark, sf):
    return ops.drop_null_target(holes(spark, sf), "brand").select("p_partkey", "brand")


@query("drop_constant_features", f"SELECT p_partkey, sparse, kind, brand, flag, big, p_retailprice FROM {HOLES}")
def _(spark, sf):
    return ops.drop_constant_features(holes(spark, sf), FEATURES)


@query("drop_singleton_classes", f"""
SELECT p_partkey, brand FROM {HOLES} AS h WHERE brand IS NULL OR (SELECT COUNT(*) FROM {HOLES} AS g WHERE g.brand = h.brand) > 1""")
def _(spark, sf):
    return ops.drop_singleton_classes(holes(spark, sf), "brand").select("p_partkey", "brand")


@query("cast_features", f"""
SELECT p_partkey, kind, CASE flag WHEN 'True' THEN 1 WHEN 'False' THEN 0 END AS flag, CASE WHEN big THEN 1 ELSE 0 END AS big
FROM {HOLES}""")
def _(spark, sf):
    return ops.cast_features(holes(spark, sf), FEATURES).select("p_partkey", "kind", "flag", "big")


@query("numeric_only", f"SELECT p_partkey, sparse, one, big, p_retailprice FROM {HOLES}")
def _(spark, sf):
    df = holes(spark, sf)
    return df.select("p_partkey", *ops.numeric_only(df, FEATURES))


@query("limit_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY MD5('42|' || o_orderkey) LIMIT 700")
def _(spark, sf):
    from glasswork.operators.splits import limit_rows

    return limit_rows(table(spark, sf, "orders"), ["o_orderkey"], 700).select("o_orderkey", "o_totalprice")


@query("clean_table", f"""
SELECT p_partkey, kind, brand, CASE flag WHEN 'True' THEN 1 WHEN 'False' THEN 0 END AS flag,
  CASE WHEN big THEN 1 ELSE 0 END AS big, p_retailprice FROM {HOLES} WHERE brand IS NOT NULL AND brand <> 'single'""")
def _(spark, sf):
    return ops.clean_pipeline(holes(spark, sf), "brand", FEATURES)[0]


@query("quick_clean", f"""
SELECT c_custkey, grouped, REPLACE(grouped, ' ', '')::DOUBLE AS grouped_numeric, mixed, TRY_CAST(mixed AS DOUBLE) AS mixed_numeric,
  flag, LOWER(flag) = 'true' AS flag_boolean,
  CASE WHEN money IS NOT NULL THEN (c_custkey % 99 + 1) * 1000 + 250.75 END::DOUBLE AS money_amount,
  CASE WHEN money IS NOT NULL THEN 'USD' END AS money_currency,
  YEAR(day::DATE)::INTEGER AS day_year, DAY(day::DATE)::INTEGER AS day_day, (ISODOW(day::DATE) - 1)::INTEGER AS day_dayofweek_int,
  MONTH(day::DATE) = 2 AS day_month_2, DAYNAME(day::DATE) = 'Friday' AS "day_dayofweek_Friday" FROM {MESSY_SQL}""")
def _(spark, sf):
    out = ops.quick_clean(messy(spark, sf))
    missing = {"nothing", "mixed_non_numeric", "day", "money"} & set(out.columns)
    assert not missing, missing
    return out.select("c_custkey", "grouped", "grouped_numeric", "mixed", "mixed_numeric", "flag", "flag_boolean",
                      "money_amount", "money_currency", "day_year", "day_day", "day_dayofweek_int", "day_month_2",
                      "day_dayofweek_Friday")
