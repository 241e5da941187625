"""Range lookup against a table of intervals, without comparing rows with intervals pairwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glasswork.functions.sqltext import ident, search
from glasswork.operators.ranks import row_positions
from glasswork.sources.checkpoint import cut_lineage

# Intervals per packed row: what one lookup row holds, searched inside the row it is joined to.
PACKED = 64


def interval_lookup(df: DataFrame, feature: str, intervals: DataFrame, output: str, lo: str = "lo", hi: str = "hi",
                    score: str = "score", default: float = 0.0, packed: int = PACKED) -> DataFrame:
    """Add ``output``: the score of the interval ``(lo, hi]`` that holds ``feature``, ``default`` where none does.

    Intervals do not overlap; a null ``lo`` or ``hi`` is open, a null feature
    gets ``default`` and NaN counts as infinity. The intervals are packed
    into runs of neighbours. A row finds its run by a search over the runs'
    upper bounds (one number per ``packed`` intervals), meets it in an equi-join
    whose strategy Catalyst picks, and its interval by a search inside the run.
    So no row meets more than one run, and the table of intervals may be as
    large as it likes.
    """
    side = intervals.select(F.coalesce(F.col(lo).cast("double"), F.lit(float("-inf"))).alias("lo"),
                            F.coalesce(F.col(hi).cast("double"), F.lit(float("inf"))).alias("hi"), F.col(score).cast("double").alias("score"))
    placed = row_positions(side, "hi", ["hi"]).withColumn("_run", F.floor(F.col("position") / packed).cast("long"))
    # Read by the bounds and by the join, so written once.
    cells = F.sort_array(F.collect_list(F.struct("hi", "lo", "score")))
    runs = placed.groupBy("_run").agg(cells.alias("c"), F.max("hi").alias("_top"))
    runs = cut_lineage(runs.select("_run", "_top", *[F.col(f"c.{n}").alias(f"_{n}") for n in ("hi", "lo", "score")]))
    value = f"nanvl(cast({ident(feature)} AS double), double('infinity'))"
    rows = df.withColumn("_tops", runs.agg(F.sort_array(F.collect_list("_top"))).scalar())
    place = search(value, "_tops", max(runs.count(), 1))
    joined = rows.withColumn("_run", F.expr(place).cast("long")).drop("_tops").join(runs.drop("_top"), "_run", "left")
    inside = search(value, "_hi", packed)
    found = F.expr(f"transform(array({inside}), i -> if(get(_lo, i) < {value}, get(_score, i), null))[0]")
    return joined.select(*df.columns, F.coalesce(F.when(F.col(feature).isNotNull(), found), F.lit(default)).alias(output))
