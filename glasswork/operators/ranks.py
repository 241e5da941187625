"""Distributed prefix sums, ranks and exact quantiles.

A window without PARTITION BY, or one partitioned by a hot key, puts that
whole group on one task. Here an ordered group is cut into buckets first:
bucket totals give every bucket its offset, and the window only runs inside a
bucket. Bucket borders come either from the data (``range_bucket``) or from the
leading digits of a uniform hash (``hash_rank``). Both are pure functions of
the row, so a recomputed partition always lands in the same bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from glasswork.functions.hashing import HEX_DIGITS, hash_int, row_hash
from glasswork.functions.sqltext import ident

# At least so many buckets; a cluster with more shuffle partitions gets as many, up to the largest.
BUCKETS = 256
MOST_BUCKETS = 4096
_STEP = 16
_SUB = 4096


def bucket_count(df: DataFrame) -> int:
    """Buckets that keep every shuffle partition busy, a multiple of the search step."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return -(-min(max(BUCKETS, wanted), MOST_BUCKETS) // _STEP) * _STEP


def range_bucket(df: DataFrame, order: str, tie: Column | None = None, buckets: int | None = None) -> DataFrame:
    """Add ``_bucket``, monotone in (``order`` nulls first, ``tie``); results that build on it are the same for any count.

    Borders are approximate quantiles, so open ranges between borders stay
    small. A value that sits on a border may be hot (a third of all rows):
    it gets a bucket of its own, which ``tie`` (a hex hash) splits further.
    """
    buckets = buckets or bucket_count(df)
    probs = [i / buckets for i in range(1, buckets)]
    found = [F.array_distinct(F.percentile_approx(order, probs, buckets * 8)).alias("b")]
    if tie is None:
        # Reading every column keeps this branch from being pruned differently,
        # so it reuses the shuffle below and the source is scanned once.
        found.append(F.bit_xor(F.xxhash64(*[F.col(c) for c in df.columns])).alias("_all"))
    borders = df.agg(*found).select(
        F.coalesce("b", F.array().cast(T.ArrayType(df.schema[order].dataType))).alias("b")
        if tie is not None else
        F.when(F.col("_all").isNotNull(), F.col("b")).otherwise(
            F.array().cast(T.ArrayType(df.schema[order].dataType))).alias("b")
    ).select("b", F.filter("b", lambda v, i: i % _STEP == _STEP - 1).alias("coarse"))
    value = F.col(order)
    df = df.withColumn("_borders", borders.select(F.struct("b", "coarse")).scalar())
    v = ident(order)
    df = df.withColumn("_skip", count_below("_borders.coarse", v, buckets // _STEP) * _STEP)
    df = df.withColumn("_below", F.col("_skip") + count_below("_borders.b", v, _STEP, "_skip"))
    hot = F.coalesce(F.get(F.col("_borders.b"), F.col("_below")) == value, F.lit(False))
    place = F.when(value.isNotNull(), F.col("_below") * 2 + hot.cast("int")).otherwise(-1)
    # Declared non-null, or the join below would push a null test into the scan.
    df = df.withColumn("_place", F.coalesce(place, F.lit(-1))).drop("_borders", "_skip", "_below")
    if tie is None:
        return df.withColumnRenamed("_place", "_bucket")
    hot = (F.col("_place") % 2 == 1) | value.isNull()
    sub = F.coalesce(F.when(hot, hash_int(tie, HEX_DIGITS)), F.lit(0))
    return df.withColumn("_bucket", F.col("_place").cast("bigint") * _SUB + sub).drop("_place")


def count_below(array: str, value: str, size: int, start: str = "0") -> Column:
    """How many of ``size`` sorted entries from ``start`` on lie strictly below a value; SQL text in.

    Written out entry by entry: unlike a lambda this stays inside generated code.
    """
    return F.expr(" + ".join(
        f"coalesce(cast(get({array}, {start} + {i}) < {value} as int), 0)" for i in range(size)))


def _join_offsets(df: DataFrame, sums, by, carry=(), ordering=()) -> DataFrame:
    """Attach, per bucket, the sums of all earlier buckets and of the group.

    ``carry`` columns also bring the last row of the previous bucket (``_edge``).
    """
    last = [F.max_by(F.struct(*carry), F.struct(*ordering)).alias("_last")] if carry else []
    totals = df.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(s) for s in sums], *last)
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy(*by)
    offsets = totals.select(
        *[F.col(c).alias(f"_o_{c}") for c in (*by, "_bucket")],
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(s).over(group).alias(f"{s}_total") for s in sums],
        *[F.lag(F.col("_last")).over(W.partitionBy(*by).orderBy("_bucket")).alias("_edge") for _ in last],
    )
    on = F.col("_bucket") == F.col("_o__bucket")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return df.join(offsets, on).drop(*[f"_o_{c}" for c in (*by, "_bucket")])


def _local_sums(df: DataFrame, sums, by, ordering, carry=()) -> DataFrame:
    before = W.partitionBy(*by, "_bucket").orderBy(*ordering).rowsBetween(W.unboundedPreceding, -1)
    cols = [
        (F.coalesce(F.sum(s).over(before), F.lit(0)) + F.col(f"_o_{s}")).alias(f"{s}_before")
        for s in sums
    ]
    if carry:
        local = F.lag(F.struct(*carry)).over(W.partitionBy(*by, "_bucket").orderBy(*ordering))
        cols.append(F.coalesce(local, F.col("_edge")).alias("previous"))
    return df.select("*", *cols).drop("_edge", *[f"_o_{s}" for s in sums])


def prefix_sums(df: DataFrame, order: str, sums, by=(), tie: Column | None = None, carry=()) -> DataFrame:
    """Exclusive running sums ``{s}_before`` and group sums ``{s}_total``.

    Rows run by ``order`` ascending (nulls first), ties by ``tie``. Without
    ``tie`` the values of ``order`` must be distinct inside a ``by`` group.
    ``carry`` names columns whose values in the previous row come back as the
    struct ``previous`` (null on the first row of a group).
    """
    sums, by = list(sums), list(by)
    names = [order]
    if tie is not None:
        df = df.withColumn("_tie", tie)
        names.append("_tie")
    ordering = [F.col(c).asc_nulls_first() for c in names]
    bucketed = range_bucket(df, order, None if tie is None else F.col("_tie"))
    joined = _join_offsets(bucketed, sums, by, carry, names)
    return _local_sums(joined, sums, by, ordering, carry).drop("_bucket", "_tie")


def row_positions(df: DataFrame, order: str, keys, by=(), seed: int = 42) -> DataFrame:
    """0-based ``position`` of each row by ``order`` then key hash, and group size ``group_rows``."""
    out = prefix_sums(df.withColumn("_one", F.lit(1).cast("bigint")), order, ["_one"], by, row_hash(keys, seed))
    return out.withColumnsRenamed({"_one_before": "position", "_one_total": "group_rows"}).drop("_one")


def hash_prefix(df: DataFrame, keys, sums, by=(), seed: int = 42, digits: int = HEX_DIGITS) -> DataFrame:
    """Running sums in key hash order inside ``by``; the leading hash digits cut every group into slices."""
    sums, by = list(sums), list(by)
    df = df.withColumn("_hash", row_hash(keys, seed))
    df = df.withColumn("_bucket", F.coalesce(hash_int(F.col("_hash"), digits), F.lit(0)))
    ordering = [F.col("_hash"), *[F.col(k) for k in keys]]
    return _local_sums(_join_offsets(df, sums, by), sums, by, ordering).drop("_hash", "_bucket")


def hash_rank(df: DataFrame, keys, by=(), seed: int = 42, at_most: int | None = None,
              digits: int = HEX_DIGITS) -> DataFrame:
    """Add ``position`` (0-based) by key hash inside ``by``, and ``group_rows``.

    Even a class holding most rows is ranked by thousands of tasks. With
    ``at_most`` only the first rows are kept, and slices that start past the
    cut are dropped before sorting.
    """
    by = list(by)
    df = df.withColumn("_hash", row_hash(keys, seed)).withColumn("_one", F.lit(1).cast("bigint"))
    df = df.withColumn("_bucket", F.coalesce(hash_int(F.col("_hash"), digits), F.lit(0)))
    df = _join_offsets(df, ["_one"], by)
    if at_most is not None:
        df = df.filter(F.col("_o__one") < at_most)
    df = _local_sums(df, ["_one"], by, [F.col("_hash"), *[F.col(k) for k in keys]])
    df = df.withColumnsRenamed({"_one_before": "position", "_one_total": "group_rows"})
    if at_most is not None:
        df = df.filter(F.col("position") < at_most)
    return df.drop("_hash", "_one", "_bucket")


def quantiles(df: DataFrame, value: str, probs, by=(), weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, as rows (``by``..., prob, quantile).

    Rows collapse to counts of distinct values; bucket totals tell which few
    buckets hold the wanted ranks, and only those are sorted. ``weight``
    names a column of row counts when ``df`` is already collapsed.
    """
    by = list(by)
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("_n"))
    placed = range_bucket(counts, value)
    along = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_rows")).select(
        *by, "_bucket", "_rows", F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_before"),
        F.sum("_rows").over(W.partitionBy(*by)).alias("_total"))

    def inside(start, size):
        """Whether a run of ranks holds either neighbour of a wanted rank."""
        return lambda s: ((F.floor(s["rank"]) >= start) & (F.floor(s["rank"]) < start + size)) | (
            (F.ceil(s["rank"]) >= start) & (F.ceil(s["rank"]) < start + size))

    wanted = F.array(*[
        F.struct(F.lit(float(p)).alias("prob"),
                 ((F.col("_total") - 1).cast("double") * F.lit(float(p))).alias("rank")) for p in probs])
    parts = parts.withColumn("_wanted", F.filter(wanted, inside(F.col("_before"), F.col("_rows")))).filter(
        F.size("_wanted") > 0)
    # Only buckets that hold a wanted rank are sorted; all others end at this join.
    side = parts.select(*[F.col(c).alias(f"_o_{c}") for c in (*by, "_bucket")], "_before", "_wanted")
    on = F.col("_bucket") == F.col("_o__bucket")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    near = placed.join(side, on)
    local = W.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    near = near.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_n").over(local), F.lit(0)))
    start, size = F.col("_start"), F.col("_n")
    hits = near.withColumn("_hit", F.explode(F.filter("_wanted", inside(start, size))))

    def holds(r):
        return (r >= start) & (r < start + size)

    low = F.max(F.when(holds(F.floor("_hit.rank")), F.col(value)))
    high = F.max(F.when(holds(F.ceil("_hit.rank")), F.col(value)))
    share = F.max(F.col("_hit.rank") - F.floor("_hit.rank"))
    return hits.groupBy(*by, F.col("_hit.prob").alias("prob")).agg(
        (low + (high - low) * share).alias("quantile")
    )


def discrete_quantiles(df: DataFrame, value: str, probs, by=()) -> DataFrame:
    """One row per group with ``edges``: for every probability p the value at rank ceil(p * rows), exact.

    Rows collapse to counts of distinct values before the shuffle. Nulls do not count.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = prefix_sums(counts, value, ["_n"], by)
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.greatest(F.ceil(F.lit(float(p)) * F.col("_n_total")), F.lit(1)).alias("rank"))
                      for i, p in enumerate(probs)])
    before = F.col("_n_before")
    held = F.filter(ranks, lambda r: (r["rank"] > before) & (r["rank"] <= before + F.col("_n")))
    hits = placed.select(*by, value, F.explode(held).alias("_hit"))
    pairs = F.sort_array(F.collect_list(F.struct("_hit.i", F.col(value).alias("v"))))
    return hits.groupBy(*by).agg(F.transform(pairs, lambda s: s["v"]).alias("edges"))


def quantile_edges(df: DataFrame, value: str, probs, by=(), weight: str | None = None) -> DataFrame:
    """One row per group with ``edges``: the quantiles in probability order."""
    rows = quantiles(df, value, probs, by, weight)
    pairs = F.sort_array(F.collect_list(F.struct("prob", "quantile")))
    return rows.groupBy(*by).agg(F.transform(pairs, lambda s: s["quantile"]).alias("edges"))


def island_ids(df: DataFrame, order: str, value: Column, by=(), tie: Column | None = None, name: str = "island") -> DataFrame:
    """Number the runs of equal ``value`` along ``order`` inside each ``by`` group, from 0.

    Runs are numbered inside buckets; a bucket's offset counts the changes in
    earlier buckets and at their edges.
    """
    by = list(by)
    names = [order]
    df = df.withColumn("_value", value)
    if tie is not None:
        df = df.withColumn("_tie", tie)
        names.append("_tie")
    placed = range_bucket(df, order, None if tie is None else F.col("_tie"))
    ordering = [F.col(c).asc_nulls_first() for c in names]
    here = W.partitionBy(*by, "_bucket").orderBy(*ordering)
    change = (F.row_number().over(here) > 1) & ~F.col("_value").eqNullSafe(F.lag("_value").over(here))
    flagged = placed.withColumn("_change", change.cast("bigint"))
    local = flagged.withColumn("_local", F.sum("_change").over(here.rowsBetween(W.unboundedPreceding, 0)))
    spot = F.struct(*names)
    parts = local.groupBy(*by, "_bucket").agg(
        F.sum("_change").alias("n"), F.min_by(F.struct("_value"), spot).alias("first"),
        F.max_by(F.struct("_value"), spot).alias("last"))
    along = W.partitionBy(*by).orderBy("_bucket")
    before = F.lag("last").over(along)
    parts = parts.withColumn("edge", (before.isNotNull() & ~F.col("first").eqNullSafe(before)).cast("bigint"))
    start = F.sum("edge").over(along.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(
        F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(*[F.col(c).alias(f"_o_{c}") for c in (*by, "_bucket")], start.alias("_start"))
    on = F.col("_bucket") == F.col("_o__bucket")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    out = local.join(offsets, on).withColumn(name, F.col("_start") + F.col("_local"))
    return out.drop("_value", "_tie", "_bucket", "_change", "_local", "_start", *[f"_o_{c}" for c in (*by, "_bucket")])
