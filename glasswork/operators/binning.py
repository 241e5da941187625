"""Feature binning: numeric cut points, category lists and bin indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswork.functions.scoring import index_text
from glasswork.models import category_axis, numeric_axis
from glasswork.operators.ranks import discrete_quantiles

MAX_BINS = 64
ACCURACY = 20_000
# A sketch keeps up to so many values; past this it costs more than counting the distinct values.
SKETCH_ACCURACY = 100_000
# Categories become model rows and SQL branches; past this the column is no category.
MAX_CATEGORIES = 100_000


def numeric_cuts(df: DataFrame, features, max_bins: int = MAX_BINS, accuracy: int = ACCURACY) -> dict[str, list[float]]:
    """Cut points per numeric feature from one pass of mergeable quantile sketches, exact above ``SKETCH_ACCURACY``."""
    if not features:
        return {}
    probs = [i / max_bins for i in range(1, max_bins)]
    if accuracy > SKETCH_ACCURACY:
        pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
        edges = discrete_quantiles(df.select(F.explode(pairs).alias("s")).select("s.*"), "value", [*probs, 1.0], ["feature"])
        found = {r["feature"]: r["edges"] for r in edges.collect()}
        return {f: sorted({q for q in found[f][:-1] if q < found[f][-1]}) if f in found else [] for f in features}
    row = df.agg(*[
        F.struct(F.percentile_approx(F.col(f).cast("double"), probs, accuracy).alias("q"), F.max(F.col(f).cast("double")).alias("top"))
        .alias(f) for f in features]).first()
    # The largest value is no cut: a bin above it would be empty.
    return {f: sorted({q for q in (row[f]["q"] or []) if q < row[f]["top"]}) for f in features}


def category_counts(df: DataFrame, features) -> DataFrame:
    """Rows (feature, category, n) of all categorical features from one shuffle, combined map-side."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("category")) for f in features])
    return df.select(F.explode(pairs).alias("s")).select("s.*").filter("category IS NOT NULL").groupBy(
        "feature", "category").agg(F.count("*").alias("n"))


def categories(df: DataFrame, features, limit: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    if not features:
        return {}
    rows = category_counts(df, features).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} categories; drop or group the columns {list(features)}, or raise the limit")
    return {f: sorted(r["category"] for r in rows if r["feature"] == f) for f in features}


def bin_features(df: DataFrame, features, max_bins: int = MAX_BINS, accuracy: int = ACCURACY,
                 max_categories: int = MAX_CATEGORIES) -> dict[str, tuple]:
    """Axis per feature: the missing bin, then intervals or categories."""
    kinds = dict(df.dtypes)
    cats = [f for f in features if kinds[f] in ("string", "boolean")]
    cuts = numeric_cuts(df, [f for f in features if f not in cats], max_bins, accuracy)
    names = categories(df, cats, max_categories)
    return {f: category_axis(names[f]) if f in names else numeric_axis(cuts[f]) for f in features}


def bin_index(feature: str, axis) -> Column:
    """Position of a value on its axis; an unseen category gets the position after the last bin."""
    return F.expr(index_text(feature, axis))


def kind_of(axis) -> str:
    return "categorical" if any(c.category is not None for c in axis) else "numeric"
