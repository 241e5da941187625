"""Table readers and writers: CSV with custom null tokens, Parquet, row samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glasswork.functions.hashing import hash_unit, row_hash

# Strings that mean null when a training table is read.
TRAIN_NULLS = ("", "N/A", "NULL", "None", "NONE")
# The wider default set used when checking or cleaning a table.
DEFAULT_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def nullify(df: DataFrame, tokens=TRAIN_NULLS) -> DataFrame:
    """Null tokens in string columns and NaN in floating columns become null."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "string" and tokens:
            c = F.when(~c.isin(*tokens), c).alias(name)
        elif kind in ("double", "float"):
            c = F.when(~F.isnan(c), c).alias(name)
        cols.append(c)
    return df.select(*cols)


def read_table(spark: SparkSession, path: str, null_tokens=TRAIN_NULLS, typed: bool = True) -> DataFrame:
    """Read CSV (by suffix) or Parquet; string columns of a CSV are typed from their values."""
    if not path.rstrip("/").endswith((".csv", ".csv.gz")):
        return nullify(spark.read.parquet(path), null_tokens)
    raw = nullify(spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"'), null_tokens)
    if not typed:
        return raw
    from glasswork.operators.profile import apply_types, infer_types

    return apply_types(raw, infer_types(raw, dates=False))


def sample_scan(df: DataFrame, keys, min_rows: int = 500, seed: int = 42) -> DataFrame:
    """Row sample by key hash: 5 % of the rows, 50 % when 5 % gives under ``min_rows``."""
    total = df.count()
    fraction = 0.05 if total * 0.05 >= min_rows else 0.5
    return df.filter(hash_unit(row_hash(keys, seed)) < fraction)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a cleaned table as Parquet or headed CSV, one file per task."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.parquet(path)
