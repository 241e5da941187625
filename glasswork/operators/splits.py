"""Folds, holdouts and row limits, keyed by row hashes instead of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glasswork.functions.hashing import hash_int, hash_unit, row_hash
from glasswork.operators.ranks import hash_rank, prefix_sums, row_positions
from glasswork.sources.checkpoint import cut_lineage

FOLDS = 5
# Seeds of folds and of the final calibration split.
SEED = 42
CALIBRATION_SEED = 123
# Ranks of a sketched time are off by at most rows / TAIL_ACCURACY.
TAIL_ACCURACY = 10_000


def limit_rows(df: DataFrame, keys, max_rows: int, seed: int = SEED) -> DataFrame:
    """Uniform sample of at most ``max_rows`` rows: the smallest key hashes, ranked slice by slice."""
    return hash_rank(df, keys, seed=seed, at_most=max_rows).drop("position", "group_rows")


def kfold(df: DataFrame, keys, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` from the row hash: a projection, no shuffle."""
    return df.withColumn("fold", hash_int(row_hash(keys, seed)) % folds)


def stratified_kfold(df: DataFrame, target: str, keys, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` so that every class is spread evenly: class sizes per fold differ by at most one."""
    ranked = hash_rank(df, keys, [target], seed)
    return ranked.withColumn("fold", F.col("position") % folds).drop("position", "group_rows")


def time_blocks(df: DataFrame, time_col: str, keys, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``block``: 0 is only trained on, block i is tested in fold i after training on earlier blocks.

    Each test block has floor(n / (folds + 1)) rows.
    """
    pos = row_positions(df, time_col, keys, seed=seed)
    size = F.floor(F.col("group_rows") / (folds + 1))
    start = F.col("group_rows") - size * folds
    late = F.floor(F.try_divide(F.col("position") - start, size)) + 1
    block = F.when(F.col("position") < start, 0).otherwise(late)
    return pos.withColumn("block", block.cast("int")).drop("position", "group_rows")


def time_series_split(df: DataFrame, time_col: str, keys, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Long form (fold, role, row): test rows of each block and all earlier rows as train."""
    blocks = time_blocks(df, time_col, keys, folds, seed)
    fold = F.explode(F.sequence(F.greatest(F.col("block"), F.lit(1)), F.lit(folds)))
    out = blocks.withColumn("fold", fold)
    return out.withColumn("role", F.when(F.col("fold") == F.col("block"), "test").otherwise("train")).drop("block")


def _tail_border(df: DataFrame, time_col: str, keys, rows: int, seed: int):
    """One row (t, h): time and hash of the first of the last ``rows`` rows, or None where so many rows have no time.

    A sketch gives a time that at least ``rows`` rows reach; only these, as
    time and hash, are ranked.
    """
    narrow = df.select(F.col(time_col).alias("t"), row_hash(keys, seed).alias("h")).filter("t IS NOT NULL")
    total = narrow.count()
    if not 0 < rows <= total:
        return None
    share = 1.0 - rows / total - 2.0 / TAIL_ACCURACY
    if share > 0:
        cut = narrow.agg(F.percentile_approx("t", share, TAIL_ACCURACY).alias("t"))
        narrow = narrow.withColumn("_cut", cut.scalar()).filter(F.col("t") >= F.col("_cut")).drop("_cut")
    ranked = prefix_sums(narrow.withColumn("one", F.lit(1).cast("bigint")), "t", ["one"], tie=F.col("h"))
    return cut_lineage(ranked.filter(F.col("one_before") == F.col("one_total") - rows).select("t", "h"))


def oot_holdout(df: DataFrame, time_col: str, keys, rows: int, seed: int = SEED) -> DataFrame:
    """Add ``is_oot``: true for the last ``rows`` rows by time, ties by row hash.

    A border between the two parts is found first, from a narrow tail of the
    table; the flag itself is a projection. Where more rows are asked for than
    have a time, all rows are ranked.
    """
    border = _tail_border(df, time_col, keys, rows, seed)
    if border is not None:
        at, least = border.select("t").scalar(), border.select("h").scalar()
        late = (F.col(time_col) > at) | ((F.col(time_col) == at) & (row_hash(keys, seed) >= least))
        return df.withColumn("is_oot", F.coalesce(late, F.lit(False)))
    pos = row_positions(df, time_col, keys, seed=seed)
    flag = F.col("position") >= F.col("group_rows") - rows
    return pos.withColumn("is_oot", flag).drop("position", "group_rows")


def calibration_split(df: DataFrame, keys, share: float = 0.2, seed: int = CALIBRATION_SEED) -> DataFrame:
    """Add ``is_calibration`` for a hash-drawn share of the rows."""
    return df.withColumn("is_calibration", hash_unit(row_hash(keys, seed)) < share)
