"""Class balancing: trimming, random oversampling, SMOTE and SMOTE-NC."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glasswork.functions.hashing import hash_int, hash_unit, row_hash
from glasswork.operators.neighbors import BLOCK, nearest
from glasswork.operators.ranks import hash_prefix, hash_rank
from glasswork.sources.checkpoint import cut_lineage

MAX_CELLS = 50_000
# One task copies a row at most this many times; larger counts are spread first.
CHUNK = 10_000


def trim_classes(df: DataFrame, target: str, keys, n_columns: int, max_cells: int = MAX_CELLS,
                 seed: int = 42) -> DataFrame:
    """Keep a uniform sample of round(max_cells / columns) rows of every larger class."""
    return hash_rank(df, keys, [target], seed, at_most=round(max_cells / n_columns)).drop("position", "group_rows")


def _with_majority(df: DataFrame, target: str, n: str) -> DataFrame:
    """Attach the largest class size; ``n`` names the column of the own class size."""
    sizes = df.groupBy(target).agg(F.first(n).alias("_n"))
    return df.withColumn("_majority", sizes.agg(F.max("_n")).scalar())


def _spread(df: DataFrame, count, name: str) -> DataFrame:
    """Explode ``name`` = 0..count-1, moving chunks of large counts to other tasks first."""
    chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((count - 1) / CHUNK)))
    out = df.withColumn("_count", count).filter("_count > 0").withColumn("_chunk", chunks)
    # With a number of its own: the rows are few before they are copied, so Spark would put them all in one task.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartition(parts, "_chunk", *[c for c in df.columns if c in ("_point", "_row")])
    low = F.col("_chunk") * CHUNK
    steps = F.sequence(low, F.least(low + CHUNK, F.col("_count")) - 1)
    return out.withColumn(name, F.explode(steps)).drop("_chunk", "_count")


def random_oversample(df: DataFrame, target: str, keys, seed: int = 42) -> DataFrame:
    """Repeat minority rows up to the majority count; ``copy`` 0 marks the original row.

    Every row gets the same number of copies, the remainder goes to the first
    rows by hash, so class sizes come out exactly equal.
    """
    ranked = _with_majority(hash_rank(df, keys, [target], seed), target, "group_rows")
    whole = F.floor(F.col("_majority") / F.col("group_rows"))
    extra = (F.col("position") < F.col("_majority") % F.col("group_rows")).cast("bigint")
    rows = ranked.withColumn("_row", row_hash(keys, seed))
    out = _spread(rows, whole + extra, "copy")
    return out.select(*df.columns, F.col("copy").cast("bigint").alias("copy"))


def _points(df: DataFrame, target: str, features, seed: int) -> DataFrame:
    """Distinct feature rows per class with their multiplicity, so copies cost one point."""
    points = df.groupBy(target, *features).agg(F.count("*").alias("_mult"))
    return points.withColumn("_point", row_hash([target, *features], seed))


def _most_frequent(array: str, field: str):
    """Most frequent value of a struct field inside an array, the smallest on ties."""
    seen = F.transform(array, lambda s: s[field])

    def counted(v):
        return F.struct((-F.size(F.filter(seen, lambda x: x.eqNullSafe(v)))).alias("n"), v.alias("v"))

    return F.array_min(F.transform(F.array_distinct(seen), counted))["v"]


def _category_costs(df: DataFrame, target: str, nums) -> DataFrame:
    """Rows (target, ``_cost``): the squared median deviation of the numeric features per class, summed up before the shuffle."""
    middle = F.array_sort(F.array(*[F.stddev_pop(f) for f in nums]))
    half = len(nums) // 2
    med = middle[half] if len(nums) % 2 else (middle[half - 1] + middle[half]) / F.lit(2.0)
    return df.groupBy(target).agg((med * med).alias("_cost"))


def smote(df: DataFrame, target: str, features, cats=(), k: int = 5, seed: int = 42,
          block: int = BLOCK) -> DataFrame:
    """Synthetic rows (target, features) that bring every class to the majority count.

    Each lies between a row and one of its k nearest rows of the class, at a
    hash-drawn share. Copies of a row count as its first neighbours. With
    ``cats`` (SMOTE-NC) a differing category costs the median deviation of the
    numeric features and a synthetic category is the most frequent one among
    the neighbours.
    """
    features, cats = list(features), list(cats)
    nums = [f for f in features if f not in cats]
    points = _points(df, target, features, seed)
    sizes = points.groupBy(target).agg(F.sum("_mult").alias("_rows"))
    sizes = sizes.withColumn("_missing", sizes.agg(F.max("_rows")).scalar() - F.col("_rows"))
    poor = sizes.filter("_missing > 0")
    # One row per class; Catalyst broadcasts it when it is small.
    base = hash_prefix(points.join(poor, target), ["_point"], ["_mult"], [target], seed)
    even = F.floor(F.col("_missing") / F.col("_rows")) * F.col("_mult")
    rest = F.col("_missing") % F.col("_rows")
    extra = F.greatest(F.least(F.col("_mult_before") + F.col("_mult"), rest) - F.col("_mult_before"), F.lit(0))
    base = base.withColumn("_new", even + extra)
    cost = None
    if cats:
        base, cost = base.join(_category_costs(df, target, nums), target), "_cost"
    # Read five times below, so the distinct points are written once.
    base = cut_lineage(base)
    near = nearest(base, "_point", nums, k, [target], cats, cost, block)
    side = base.select(F.col("_point").alias("_other"), F.col("_mult").alias("_omult"), *[
        F.col(f).alias(f"_o_{f}") for f in features])
    links = near.select(target, "_point", F.posexplode("neighbors").alias("_pos", "_nb")).select(
        target, "_point", "_pos", F.col("_nb.id").alias("_other"))
    values = F.struct(*[F.col(f"_o_{f}").alias(f) for f in features])
    around = links.join(side, "_other").groupBy("_point").agg(
        F.sort_array(F.collect_list(F.struct("_pos", "_omult", values.alias("v")))).alias("_around"))
    joined = base.join(around, "_point", "left")
    own = F.array_repeat(F.struct(*features), F.least(F.col("_mult") - 1, F.lit(k)).cast("int"))
    others = F.flatten(F.transform(F.coalesce("_around", F.array().cast(joined.schema["_around"].dataType)),
                                   lambda s: F.array_repeat(s["v"], F.least(s["_omult"], F.lit(k)).cast("int"))))
    joined = joined.withColumn("_k", F.slice(F.concat(own, others), 1, k)).filter(F.size("_k") > 0)
    joined = joined.withColumns({f"_mode_{c}": _most_frequent("_k", c) for c in cats}) if cats else joined
    rows = _spread(joined, F.col("_new"), "_copy")
    draw = row_hash(["_point", "_copy"], seed)
    pick = F.element_at("_k", (hash_int(draw, 8) % F.size("_k") + 1).cast("int"))
    rows = rows.withColumns({"_pick": pick, "_u": hash_unit(draw, 9)})
    out = [F.col(f"_mode_{f}").alias(f) if f in cats else
           (F.col(f) + (F.col("_pick")[f] - F.col(f)) * F.col("_u")).alias(f) for f in features]
    return rows.select(target, *out)


def upsample(df: DataFrame, target: str, features, keys, task: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Balanced table (target, features): original rows plus synthetic ones; regression is left unchanged.

    SMOTE-NC with categorical features, SMOTE without. Random oversampling
    when a class has too few rows for k neighbours, a feature holds nulls or
    there is no numeric feature. Only class counts are collected.
    """
    features = list(features)
    rows = df.select(target, *features)
    if task == "regression":
        return rows
    cats = [f for f, kind in rows.dtypes if f in features and kind == "string"]
    nulls = F.count_if(F.concat_ws("", *[F.col(f).isNull().cast("string") for f in features]).contains("true"))
    sizes = rows.groupBy(target).agg(F.count("*").alias("n"), nulls.alias("nulls"))
    stats = sizes.agg(F.max("n").alias("most"), F.sum("nulls").alias("nulls")).withColumn(
        "few", sizes.filter(F.col("n") < sizes.agg(F.max("n")).scalar()).agg(F.min("n")).scalar()).first()
    possible = len(cats) < len(features) and not stats["nulls"] and (stats["few"] is None or stats["few"] > k)
    if not possible:
        return random_oversample(df, target, keys, seed).select(target, *features)
    extra = smote(rows, target, features, cats, k, seed)
    return rows.unionByName(extra.select(target, *[F.col(f).cast(dict(rows.dtypes)[f]).alias(f) if f in cats
                                                   else F.col(f) for f in features]))
