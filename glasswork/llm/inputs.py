"""What every operator of this package does with its input and its files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from glasswork.sources.checkpoint import shared_dir

_SLICE_BYTES = 1_000_000


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, whatever folder they start in."""
    import glasswork

    root = os.path.dirname(os.path.dirname(os.path.abspath(glasswork.__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``_id`` long, ``_text`` string): every row stays, a null text reads as ''.

    Only the two named columns are taken, so extra columns cannot clash.
    """
    importable(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def numbered(docs: DataFrame, id_col: str) -> DataFrame:
    """Rows (_row long, _doc struct of all columns) with a number of its own for every row.

    Where the ids are whole numbers, none null and none twice, they are the
    numbers. Otherwise the rows are numbered in a written table, since a number
    given while reading may change when a lost task is repeated.
    """
    doc = F.struct(*[F.col(c) for c in docs.columns]).alias("_doc")
    if dict(docs.dtypes).get(id_col) in ("bigint", "int", "smallint", "tinyint"):
        ids = docs.select(F.col(id_col).cast("long").alias("_row"))
        all_rows = ids.agg(F.count(F.lit(1)), F.count("_row")).first()
        if all_rows[0] == all_rows[1] == ids.distinct().count():
            return docs.select(F.col(id_col).cast("long").alias("_row"), doc)
    return written(docs.select(doc).withColumn("_row", F.monotonically_increasing_id()), "numbered").select("_row", "_doc")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: cuts the lineage and survives lost executors."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_row_bytes(df: DataFrame, column: str, limit: int) -> bool:
    """Whether the texts of a column hold at most ``limit`` characters in all."""
    total = df.agg(F.sum(F.length(column))).first()[0]
    return (total or 0) <= limit


def slices(rows: pa.RecordBatch, column: str, size: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``size`` bytes of text; a longer text is a slice."""
    ends = np.cumsum(pc.binary_length(rows[column]).to_numpy(zero_copy_only=False).astype("i8"))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield rows.slice(a, b - a)
        a = b
