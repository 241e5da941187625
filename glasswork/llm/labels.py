"""A bounded, reproducible sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LABELLED_ROWS = 20_000


def labelled_sample(labels: DataFrame, label_col: str, id_col: str = "doc_id", rows: int = LABELLED_ROWS,
                    where: Column | None = None) -> dict[int, int]:
    """At most ``rows`` ids with their 0/1 label, the smallest by a hash of the id, so the sample is even.

    Null ids and labels other than 0 and 1 do not count; an id with several
    labels has the largest. ``where`` restricts the ids, as column ``_id``. The
    bound keeps what the driver holds and every task receives fixed.
    """
    named = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
    named = named.filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
    if where is not None:
        named = named.filter(where)
    one = named.groupBy("_id").agg(F.max("_label").alias("_label"))
    return {r._id: r._label for r in one.orderBy(F.xxhash64("_id"), "_id").limit(rows).collect()}
