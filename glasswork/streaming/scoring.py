"""Scoring is map-only and stateless, so the batch operator runs on a stream as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame

from glasswork.operators.score import predict


def score_stream(df: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """Predictions for every row of a streaming DataFrame (``readStream`` in, ``writeStream`` out)."""
    if not df.isStreaming:
        raise ValueError("expected a streaming DataFrame; use predict() for a batch one")
    return predict(df, model, threshold)
