"""Profiling and validation: target checks, null counts, task and type inference, feature selection.

Only one row per column (counts and flags) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Text accepted as a number (plain or exponent notation), and as a boolean.
NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
BOOLEANS = ("True", "False", "true", "false")
# Column name parts that mark a date column.
DATE_NAMES = ("date", "dt")

_INTEGRAL = ("tinyint", "smallint", "int", "bigint")
_FLOATING = ("float", "double")


def as_number(c: Column) -> Column:
    """Number in a string, or null; suffixes such as ``1f`` are text."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def as_timestamp(c: Column) -> Column:
    return c.try_cast("timestamp")


def is_integral(kind: str) -> bool:
    return kind in _INTEGRAL


def is_floating(kind: str) -> bool:
    return kind in _FLOATING or kind.startswith("decimal")


def is_feature_type(kind: str) -> bool:
    return is_integral(kind) or is_floating(kind) or kind in ("string", "boolean")


def check_target(df: DataFrame, target: str) -> DataFrame:
    """One row: distinct non-null values, extremes and a verdict.

    ``constant`` when one value is left, ``not_0_1`` when two values are not 0
    and 1, otherwise ``ok``.
    """
    # Minimum and maximum tell one, two and more values apart without a distinct count.
    span = df.agg(F.min(target).alias("lo"), F.max(target).alias("hi"))
    between = df.filter(F.col(target).isNotNull()).select(target).distinct()
    stats = between.agg(F.count(target).alias("distinct_values"))
    text = F.concat_ws(",", F.col("lo").cast("string"), F.col("hi").cast("string"))
    verdict = F.when(F.col("distinct_values") == 1, "constant").when(
        (F.col("distinct_values") == 2) & ~text.isin("0,1", "0.0,1.0", "false,true"), "not_0_1").otherwise("ok")
    both = span.withColumn("distinct_values", stats.scalar())
    return both.select("distinct_values", F.col("lo").cast("string").alias("lo"),
                       F.col("hi").cast("string").alias("hi"), verdict.alias("verdict"))


def require_target(df: DataFrame, target: str) -> str:
    """Raise on a constant target; return the verdict otherwise."""
    verdict = check_target(df, target).first()["verdict"]
    if verdict == "constant":
        raise ValueError("Target column needs more than 1 unique value")
    return verdict


def null_counts(df: DataFrame, columns=None) -> DataFrame:
    """Rows (column, nulls) for the columns that hold nulls; one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "nulls").filter("nulls > 0")


def infer_task(df: DataFrame, target: str) -> str:
    """``regression`` for floats and for integers of more than ten values, else ``classification``.

    Ten distinct values settle an integer target, so the scan of distinct
    values stops at the eleventh.
    """
    kind = dict(df.dtypes)[target]
    if is_floating(kind):
        return "regression"
    if is_integral(kind):
        few = df.filter(F.col(target).isNotNull()).select(target).distinct().limit(11)
        return "regression" if few.count() > 10 else "classification"
    return "classification"


def distinct_counts(df: DataFrame, columns) -> DataFrame:
    """Rows (column, n_rows, n_distinct, n_lengths, has_null): exact counts for all columns in one shuffle.

    Every column becomes (column, text) pairs, combined map-side, so a value
    that fills most of a column costs one row per task.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns
    ])).alias("s")).select("s.*")
    # Long texts travel as digests of the whole text.
    short = F.when(F.length("v") > 64, F.sha2("v", 256)).otherwise(F.col("v"))
    values = pairs.groupBy("column", F.length("v").alias("size"), short.alias("v")).agg(F.count("*").alias("n"))
    return values.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.count("v").alias("n_distinct"),
        F.size(F.collect_set("size")).alias("n_lengths"), F.bool_or(F.col("v").isNull()).alias("has_null"))


def approx_distinct_counts(df: DataFrame, columns, rsd: float = 0.01) -> DataFrame:
    """The same table from sketches: no shuffle of values, counts within ``rsd``."""
    aggs = [F.struct(
        F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"),
        F.approx_count_distinct(F.col(c), rsd).alias("n_distinct"),
        F.size(F.collect_set(F.length(F.col(c).cast("string")))).alias("n_lengths"),
        F.bool_or(F.col(c).isNull()).alias("has_null")) for c in columns]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def infer_types(df: DataFrame, columns=None, dates: bool = True) -> dict[str, str]:
    """Type every string column holds: bigint, double, timestamp, boolean or string.

    All non-null values must parse. A number wins over a date, so ``2010``
    stays numeric. One pass, no shuffle of values.
    """
    kinds = dict(df.dtypes)
    columns = [c for c in (columns or df.columns) if kinds[c] == "string"]
    if not columns:
        return {}
    flags = []
    for c in columns:
        v = F.col(c)
        date = F.when(v.isNotNull(), as_timestamp(v).isNotNull()) if dates else F.lit(False)
        flags += [
            F.bool_and(v.isin(*BOOLEANS)).alias(f"{c}|boolean"),
            F.bool_and(v.rlike(r"^\s*[+-]?[0-9]{1,18}\s*$")).alias(f"{c}|bigint"),
            F.bool_and(v.rlike(NUMBER)).alias(f"{c}|double"),
            F.bool_and(date).alias(f"{c}|timestamp"),
        ]
    row = df.agg(*flags).first()
    order = ("boolean", "bigint", "double", "timestamp")
    return {c: next((k for k in order if row[f"{c}|{k}"]), "string") for c in columns}


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.trim(F.col(c)).try_cast(k) for c, k in types.items() if k != "string"})


# A sketch of 2^13 registers has a standard error of 0.9 %; its count is taken to be off by at most this share, eleven
# times that, and so many values.
_SKETCH_BITS, _SKETCH_BOUND, _SKETCH_SLACK = 13, 0.1, 3
_PLAIN = (*_INTEGRAL, *_FLOATING, "string", "boolean", "date", "timestamp", "timestamp_ntz")


def _narrow_stats(df: DataFrame, columns) -> dict[str, dict]:
    """Per column from one aggregate that moves no values: rows, nulls, whether all values and all lengths are
    equal, the span of integers, and a sketch of the distinct values."""
    kinds, parts = dict(df.dtypes), []
    for c in columns:
        v = F.col(c) if kinds[c] in _PLAIN or kinds[c].startswith("decimal") else F.col(c).cast("string")
        size = F.length(F.col(c).cast("string"))
        span = (F.max(v).cast("decimal(38,0)") - F.min(v).cast("decimal(38,0)") + 1).cast("double") if kinds[c] in _INTEGRAL else F.lit(None).cast("double")
        parts.append(F.struct(
            F.count(F.lit(1)).alias("rows"), F.count(v).alias("known"), F.min(v).eqNullSafe(F.max(v)).alias("one"),
            F.min(size).eqNullSafe(F.max(size)).alias("one_length"), span.alias("span"),
            F.hll_sketch_estimate(F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), _SKETCH_BITS)).alias("sketch")).alias(c))
    return {c: r.asDict() for c, r in df.agg(*parts).first().asDict().items()}


def _first_reason(column: str, kind: str, low: float, high: float, stats: dict) -> tuple[str | None, bool]:
    """(reason, settled) by the rules that need no type inference, for a share of distinct values between two bounds."""
    integral, floating = kind in _INTEGRAL, kind in _FLOATING or kind.startswith("decimal")
    rules = [
        (not floating, 1.0, False, "unique"), (integral and stats["one_length"], 0.9, True, "high_cardinality_int"),
        (any(part in column.lower() for part in DATE_NAMES), None, False, "date_name"), (kind == "string", 0.4, True, "high_cardinality_text"),
        (stats["one"] and stats["known"] > 0, None, False, "constant")]
    for applies, limit, above, reason in rules:
        if not applies:
            continue
        if limit is None or (low > limit if above else low >= limit):
            return reason, True
        if high > limit if above else high >= limit:
            return None, False
    return None, True


def feature_reasons(df: DataFrame, columns=None, approx: bool = False) -> DataFrame:
    """Rows (column, reason): why a column is not a feature; reason null means it is one.

    Rules run in order, the first match counts: all values unique (not for
    floats); nearly unique integers of one text length; a date-like name;
    strings with many values; a single value; a type that is not text or number.

    One narrow pass settles most columns: by type and name, by nulls and the
    span of integers, which bound the distinct values, and by a sketch whose
    count is far from every limit. Only columns left open are counted exactly,
    and only those shuffle their values; ``approx`` takes the sketch instead.
    """
    kinds = dict(df.dtypes)
    columns = list(columns or df.columns)
    stats = _narrow_stats(df, columns) if columns else {}
    found, opened = {}, []
    for c in columns:
        s = stats[c]
        s["sketch"] = s["sketch"] or 0
        rows, null = max(s["rows"], 1), int(s["known"] < s["rows"])
        most = min(s["known"], s["span"] if s["span"] is not None else s["known"], s["sketch"] * (1 + _SKETCH_BOUND) + _SKETCH_SLACK)
        if approx:
            low = high = min(s["sketch"], s["known"])
        else:
            low, high = (1.0, 1.0) if s["one"] and s["known"] else (s["sketch"] * (1 - _SKETCH_BOUND) - _SKETCH_SLACK, most)
            low = min(low, high)
        reason, settled = _first_reason(c, kinds[c], (low + null) / rows, (high + null) / rows, s)
        found[c] = reason
        if not settled:
            opened.append(c)
    for r in distinct_counts(df, opened).collect() if opened else []:
        c = r["column"]
        share = (r["n_distinct"] + int(r["has_null"])) / max(r["n_rows"], 1)
        found[c] = _first_reason(c, kinds[c], share, share, stats[c])[0]
    plain = [c for c in columns if found[c] is None]
    inferred = infer_types(df, [c for c in plain if kinds[c] == "string"]) if any(kinds[c] == "string" for c in plain) else {}
    for c in plain:
        kind = inferred.get(c, kinds[c])
        known = kinds[c] in _INTEGRAL or kinds[c] in _FLOATING or kinds[c].startswith("decimal")
        if not known and not (kinds[c] == "string" and kind in ("string", "bigint", "double")):
            found[c] = f"type_{kind}"
    return df.sparkSession.createDataFrame([(c, found[c]) for c in columns], "column string, reason string")


def select_features(df: DataFrame, target: str | None = None, approx: bool = False) -> list[str]:
    columns = [c for c in df.columns if c != target]
    kept = {r["column"] for r in feature_reasons(df, columns, approx).filter("reason IS NULL").collect()}
    return [c for c in columns if c in kept]


def fold_report(df: DataFrame, target: str, fold: str = "fold", task: str | None = None) -> DataFrame:
    """Per fold: rows, then mean and population deviation (regression) or counts per class."""
    if (task or infer_task(df, target)) == "regression":
        return df.groupBy(fold).agg(F.count("*").alias("n"), F.avg(target).alias("mean"),
                                    F.stddev_pop(target).alias("std"))
    return df.groupBy(fold, target).agg(F.count("*").alias("n"))
