"""Drift of scores over event time, on a stream or on a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BINS = 10
# A share never counts as less than this, so an empty bin has a finite part in the index.
LEAST_SHARE = 1e-4


def _bin(score: str, bins: int) -> Column:
    """Equal bins of scores from 0 to 1; scores outside go to the first or last one."""
    return F.least(F.greatest(F.floor(F.col(score) * bins), F.lit(0)), F.lit(bins - 1))


def _counts(score: str, bins: int) -> list[Column]:
    place = _bin(score, bins)
    return [F.count_if(place == b).alias(f"n{b}") for b in range(bins)]


def reference_shares(scored: DataFrame, score: str = "probability", bins: int = BINS) -> list[float]:
    """Share of each score bin in a table of the past, the expectation of ``drift``; null scores are left out."""
    row = scored.filter(F.col(score).isNotNull()).agg(*_counts(score, bins)).first()
    total = sum(row)
    return [n / total if total else 1.0 / bins for n in row]


def drift(scored: DataFrame, time: str, reference: list[float], score: str = "probability", every: str = "1 hour",
          late: str = "10 minutes", y: str | None = None) -> DataFrame:
    """Rows (start, end, n, mean_score, counts, psi) per window of event time; with ``y`` also the share of positives.

    ``psi`` is the population stability index of the window's score bins
    against ``reference``. On a stream the state is one row of counts per open
    window: a window is final once the watermark, ``late`` behind the latest
    event, has passed its end, and rows that come later are dropped. A batch
    table gives the same rows with none dropped. Null scores and null times are
    left out; a window without rows gives none.
    """
    bins = len(reference)
    rows = scored.filter(F.col(score).isNotNull() & F.col(time).isNotNull())
    kind = dict(rows.dtypes)[time]
    if rows.isStreaming and kind == "timestamp_ntz":  # a watermark needs a point in time; without a zone it is read in the session's
        rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    more = [F.avg(F.col(y).cast("double")).alias("positive_share")] if y else []
    grouped = rows.groupBy(F.window(time, every).alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), *_counts(score, bins), *more)
    terms = []
    for b, expected in enumerate(reference):
        share = F.greatest(F.col(f"n{b}") / F.col("n"), F.lit(LEAST_SHARE))
        expected = F.lit(float(max(expected, LEAST_SHARE)))
        terms.append((share - expected) * F.log(share / expected))
    psi = sum(terms[1:], terms[0])
    start, end = (F.col(f"_w.{c}").cast(kind).alias(c) for c in ("start", "end"))
    return grouped.select(start, end, "n", "mean_score",
                          F.array(*[f"n{b}" for b in range(bins)]).alias("counts"), psi.alias("psi"), *(["positive_share"] if y else []))
