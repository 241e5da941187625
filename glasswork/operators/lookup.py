"""Compaction of lookup tables: explode, merge equal neighbours, orient and nest pairs.

All operators take the tables of many models at once; ``keys`` tell them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswork.operators.ranks import island_ids


def explode_lookup(df: DataFrame, keys, lists) -> DataFrame:
    """Parallel arrays to rows, with their ``position``."""
    zipped = F.arrays_zip(*[F.col(c) for c in lists])
    return df.select(*keys, F.posexplode(zipped).alias("position", "cell")).select(*keys, "position", "cell.*")


def merge_runs(df: DataFrame, keys, kind: str = "kind") -> DataFrame:
    """Collapse neighbouring bins with equal score: last bound, first lower, last upper.

    Rows hold position, bound (null for the missing bin), category, score,
    lower, upper. Categories and the missing bin never merge.
    """
    alone = (F.col(kind) == "categorical") | F.col("bound").isNull()
    value = F.struct(F.col("score"), F.when(alone, F.col("position")).otherwise(F.lit(-1)))
    tagged = island_ids(df, "position", value, keys)
    return tagged.groupBy(*keys, kind, "island").agg(
        F.max("position").alias("position"), F.max_by("bound", "position").alias("bound"),
        F.max_by("category", "position").alias("category"), F.first("score").alias("score"),
        F.min_by("lower", "position").alias("lower"), F.max_by("upper", "position").alias("upper"),
    ).drop("island")


def orient_pairs(df: DataFrame) -> DataFrame:
    """Swap a pair whose first axis is numeric and longer than the second; the grid is transposed.

    Rows hold feat_1, feat_2, type_1, type_2, bound_1, bound_2 and scores (a list of rows).
    """
    swap = (F.size("bound_1") > F.size("bound_2")) & (F.col("type_1") == "numeric")
    across = F.transform(F.sequence(F.lit(0), F.size("bound_2") - 1),
                         lambda j: F.transform("scores", lambda row: F.get(row, j)))

    def either(a, b):
        return F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a)

    rest = [c for c in df.columns if c not in
            {"feat_1", "feat_2", "type_1", "type_2", "bound_1", "bound_2", "scores"}]
    return df.select(
        *rest, either("feat_1", "feat_2"), either("feat_2", "feat_1"), either("type_1", "type_2"),
        either("type_2", "type_1"), either("bound_1", "bound_2"), either("bound_2", "bound_1"),
        F.when(swap, across).otherwise(F.col("scores")).alias("scores"))


def explode_pairs(df: DataFrame, keys) -> DataFrame:
    """One row per cell of the grid, with both positions and bounds."""
    rows = df.select(*keys, "bound_1", "bound_2", F.posexplode("scores").alias("pos_1", "_row"))
    return rows.select(
        *keys, "pos_1", F.get("bound_1", F.col("pos_1")).alias("bound_1"), F.col("bound_2").alias("_b2"),
        F.posexplode("_row").alias("pos_2", "score"),
    ).select(*keys, "pos_1", "bound_1", "pos_2", F.get("_b2", F.col("pos_2")).alias("bound_2"), "score")


def merge_pair_runs(df: DataFrame, keys, categorical: Column | None = None) -> DataFrame:
    """Merge equal scores along the second axis inside one first-axis bin.

    Categorical, missing and +inf second bounds stay on their own.
    """
    alone = F.col("bound_2").isNull() | (F.col("bound_2") == float("inf"))
    if categorical is not None:
        alone = alone | categorical
    value = F.struct(F.col("score"), F.when(alone, F.col("pos_2")).otherwise(F.lit(-1)))
    by = [*keys, "pos_1"]
    tagged = island_ids(df, "pos_2", value, by)
    return tagged.groupBy(*by, "island").agg(
        F.first("bound_1").alias("bound_1"), F.max("pos_2").alias("pos_2"),
        F.max_by("bound_2", "pos_2").alias("bound_2"), F.first("score").alias("score")).drop("island")


def nest_pairs(df: DataFrame, keys) -> DataFrame:
    """Second axis as lists per first-axis bin; a missing first bin keeps its row.

    A list has one entry per bin of the second axis, never one per data row.
    """
    cells = F.sort_array(F.collect_list(F.struct("pos_2", "bound_2", "score")))
    nested = df.groupBy(*keys, "pos_1", "bound_1").agg(cells.alias("_cells"))
    return nested.select(*keys, "pos_1", "bound_1", F.transform("_cells", lambda s: s["bound_2"]).alias("bounds_2"),
                         F.transform("_cells", lambda s: s["score"]).alias("scores"))


def round_scores(df: DataFrame, decimals: int = 15, columns=("score",)) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), decimals) for c in columns})


def attach_scores(df: DataFrame, scores: DataFrame, on) -> DataFrame:
    """Left join of values back to bins, on the values themselves rather than on a hash of them."""
    return df.join(scores, on, "left")
