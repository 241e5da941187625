"""Global and row-level explanations from term contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glasswork.functions import scoring as sc
from glasswork.models import AdditiveModel, LinearModel, TreeModel
from glasswork.operators.binning import bin_index
from glasswork.operators.ranks import hash_rank
from glasswork.sources.session import with_small_methods
from glasswork.sources.store import extract_lookup


def term_names(model) -> list[str]:
    return [t.name for t in model.terms] if isinstance(model, AdditiveModel) else list(model.features)


def term_importance(df: DataFrame, model) -> DataFrame:
    """Rows (term, importance): mean absolute contribution over the rows, averaged over classes. One pass."""
    pairs = sc.contributions(model)
    names, outputs = term_names(model), len(sc.outputs(model))
    scored = with_small_methods(df).select(*[F.expr(text).alias(f"c{i}") for i, (_, text) in enumerate(pairs)])
    means = scored.agg(*[F.avg(F.abs(f"c{i}")).alias(f"c{i}") for i in range(len(pairs))])
    rows = []
    for i, n in enumerate(names):
        total = F.col(f"c{i}")
        for k in range(1, outputs):
            total = total + F.col(f"c{i + k * len(names)}")
        rows.append(F.struct(F.lit(n).alias("term"), (total / F.lit(float(outputs))).alias("importance")))
    return means.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def linear_importance(df: DataFrame, model: LinearModel) -> DataFrame:
    return term_importance(df, model)


def shape_function(df: DataFrame, model: AdditiveModel) -> DataFrame:
    """The lookup table with the row count of every bin of single-feature terms."""
    table = extract_lookup(df.sparkSession, model)
    singles = [t for t in model.terms if len(t.features) == 1]
    cells = F.array(*[
        F.struct(F.lit(t.features[0]).alias("feature"), bin_index(t.features[0], t.axes[0]).alias("position"))
        for t in singles])
    counts = df.select(F.explode(cells).alias("c")).select("c.*").groupBy("feature", "position").agg(
        F.count("*").alias("rows"))
    single = table.filter("feature2 IS NULL").join(counts, ["feature", "position"], "left")
    pair = table.filter("feature2 IS NOT NULL").withColumn("rows", F.lit(None).cast("bigint"))
    single = single.withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))
    name = F.concat_ws("_x_", "feature", "feature2").alias("term")
    out = single.select(*table.columns, "rows").unionByName(pair.select(*table.columns, "rows"))
    return out.select(name, "*")


def explain_rows(df: DataFrame, model, keys, n: int | None = 10, seed: int = 42) -> DataFrame:
    """Rows (keys, term, value, contribution) for ``n`` hash-drawn rows, or for all with ``n=None``.

    A tree contributes, per split on the way, the change of its node value.
    """
    rows = df if n is None else hash_rank(df, keys, seed=seed, at_most=n).drop("position", "group_rows")
    if isinstance(model, TreeModel):
        names = list(model.features)
        parts = [F.expr(_path_change(model, f)).alias(f"c{i}") for i, f in enumerate(names)]
    else:
        names = term_names(model)
        pairs = sc.contributions(model)
        parts = [F.expr(text).alias(f"c{i}") for i, (_, text) in enumerate(pairs)]
    outputs = [str(c) for c in sc.outputs(model)] if not isinstance(model, TreeModel) else ["None"]
    features = [t.features for t in model.terms] if isinstance(model, AdditiveModel) else [(f,) for f in names]
    scored = with_small_methods(rows).select("*", *parts)
    cells = []
    for k, cls in enumerate(outputs):
        for i, name in enumerate(names):
            shown = F.concat_ws(" x ", *[F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in features[i]])
            cells.append(F.struct(
                F.lit(name).alias("term"), (F.lit(cls) if cls != "None" else F.lit(None).cast("string")).alias("class"),
                shown.alias("value"), F.col(f"c{i + k * len(names)}").alias("contribution")))
    return scored.select(*keys, F.explode(F.array(*cells)).alias("e")).select(*keys, "e.*")


def _node_value(model: TreeModel, node) -> float:
    """Mean, or share of the last class."""
    if model.task == "regression":
        return node.value[0]
    total = sum(node.value)
    return node.value[-1] / total if total else 0.0


def _path_change(model: TreeModel, feature: str) -> str:
    """CASE text: summed value changes over the splits on ``feature`` along a row's path."""
    nodes = {n.id: n for n in model.nodes}
    totals = {}

    def walk(node, so_far):
        if node.feature is None:
            totals[node.id] = so_far
            return
        for child in (nodes[node.left], nodes[node.right]):
            change = _node_value(model, child) - _node_value(model, node) if node.feature == feature else 0.0
            walk(child, so_far + change)

    walk(model.nodes[0], 0.0)
    return sc.tree_text(model, lambda n: sc.number(totals[n.id]))


