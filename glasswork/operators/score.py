"""Scoring a table with a model: map-only, inside whole-stage codegen."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from glasswork.functions import scoring as sc
from glasswork.functions.sqltext import alias, label, number
from glasswork.models import AdditiveModel, TreeModel
from glasswork.sources.session import with_small_methods


def _layer(df: DataFrame, pairs) -> DataFrame:
    return with_small_methods(df).select("*", *[F.expr(text).alias(name) for name, text in pairs])


def score(df: DataFrame, model, calibrator=None) -> DataFrame:
    """Add contributions, sums, probabilities and the label to every row."""
    if isinstance(model, TreeModel):
        return score_tree(df, model, calibrator)
    out = _layer(df, [*sc.intercepts(model), *sc.contributions(model)])
    for layer in [sc.sums(model), *sc.link(model)]:
        out = _layer(out, layer)
    if calibrator is not None and model.task == "binary":
        out = _layer(out, [("calibrated_probability", calibrator.expression("probability"))])
    return out


def score_tree(df: DataFrame, model: TreeModel, calibrator=None) -> DataFrame:
    """Add the tree's prediction and, for classes, the class shares of the leaf, calibrated if asked."""
    cols = [("prediction", sc.tree_text(model))]
    if model.task == "binary":
        cols.append(("probability", sc.tree_text(model, lambda n: sc.leaf_share(n, 1))))
    elif model.task == "multiclass":
        cols += [
            (alias(f"probability_{c}"), sc.tree_text(model, lambda n, k=k: sc.leaf_share(n, k)))
            for k, c in enumerate(model.classes)
        ]
    out = _layer(df, cols)
    if calibrator is not None and model.task == "binary":
        out = _layer(out, [("calibrated_probability", calibrator.expression("probability"))])
    return out


def score_term(df: DataFrame, term, output: int = 0) -> DataFrame:
    """Add one term's contribution as ``{term}_score``."""
    return _layer(df, [(alias(f"{term.name}_score"), sc.lookup_text(term, output))])


def class_vectors(df: DataFrame, model: AdditiveModel, name: str = "class_scores") -> DataFrame:
    """Additive multiclass sums as one array: each term is looked up once, not per class."""
    temp = [f"_term_{i}" for i in range(len(model.terms))]
    out = _layer(df, list(zip(temp, map(sc.vector_text, model.terms))))
    per_class = [
        " + ".join([number(model.intercept[k]), *[f"{t}[{k}]" for t in temp]])
        for k in range(len(model.classes))
    ]
    return _layer(out, [(name, f"array({', '.join(per_class)})")]).drop(*temp)


def score_categories(df: DataFrame, feature: str, lookup: DataFrame, output: str | None = None) -> DataFrame:
    """Categorical term by join, for axes too wide for a CASE.

    ``lookup`` has columns category and score; unseen values score 0. The join
    side is left to Catalyst, which broadcasts the lookup only when it is small.
    """
    output = output or alias(f"{feature}_score")
    side = lookup.select(F.col("category").alias("_category"), F.col("score").alias("_score"))
    joined = df.join(side, F.col(feature).eqNullSafe(F.col("_category")), "left")
    return joined.withColumn(output, F.coalesce("_score", F.lit(0.0))).drop("_category", "_score")


def predict(df: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """Source columns plus ``prediction`` and, for classes, the probabilities."""
    out = score(df, model)
    # A tree's label is its leaf's majority, which is the label at one half; another threshold reads the share.
    if model.task == "binary" and (not isinstance(model, TreeModel) or threshold != 0.5):
        zero, one = model.classes or (0, 1)
        out = out.withColumn(
            "prediction",
            F.expr(f"CASE WHEN probability > {number(threshold)} THEN {label(one)} "
                   f"WHEN probability IS NOT NULL THEN {label(zero)} END"),
        )
    keep = ["prediction", *probability_columns(model)]
    return out.select(*df.columns, *keep)


def probability_columns(model) -> list[str]:
    if model.task == "regression":
        return []
    if model.task == "binary":
        return ["probability"]
    return [alias(f"probability_{c}") for c in model.classes]


def leaf_ids(df: DataFrame, model: TreeModel, name: str = "leaf") -> DataFrame:
    return _layer(df, [(name, sc.tree_text(model, lambda n: str(n.id)))])


def leaf_stats(df: DataFrame, model: TreeModel) -> DataFrame:
    """Rows, majority label and majority share of every leaf that rows reach."""
    counts = leaf_ids(df, model).groupBy("leaf", F.col(model.target).alias("y")).agg(F.count("*").alias("n"))
    best = F.max_by(F.col("y"), F.struct(F.col("n"), F.col("y")))
    return counts.groupBy("leaf").agg(
        F.sum("n").alias("rows"), best.alias("majority"), (F.max("n") / F.sum("n")).alias("share")
    )


def run_sql_model(sql: str, df: DataFrame) -> DataFrame:
    """Run exported SQL text over a DataFrame, which goes in as an argument: no view is left behind."""
    return df.sparkSession.sql(sql.replace(sc.SOURCE, "{scored_source}"), scored_source=with_small_methods(df))


def score_parity(a: DataFrame, b: DataFrame, key, left: str, right: str, tol: float = 1e-5) -> DataFrame:
    """One row: compared rows, largest relative difference, within tolerance or not."""
    keys = [key] if isinstance(key, str) else list(key)
    pair = a.select(*keys, F.col(left).alias("_a")).join(b.select(*keys, F.col(right).alias("_b")), keys)
    scale = F.when(F.col("_b") == 0, F.lit(1.0)).otherwise(F.abs("_b"))
    gap = F.max(F.abs(F.col("_a") - F.col("_b")) / scale)
    return pair.agg(F.count("*").alias("rows"), gap.alias("max_diff")).withColumn(
        "ok", F.coalesce(F.col("max_diff") <= tol, F.lit(True))
    )


def round_model(model, decimals: int = 15):
    """Round scores or coefficients, as done before printing them."""
    if isinstance(model, AdditiveModel):
        def fix(values):
            return {k: tuple(round(x, decimals) for x in v) for k, v in values.items()}
        return replace(model, terms=tuple(replace(t, scores=fix(t.scores)) for t in model.terms))
    if isinstance(model, TreeModel):
        return model
    rows = tuple(tuple(round(c, decimals) for c in row) for row in model.coefficients)
    return replace(model, coefficients=rows)


def export_sql(model, path: str | None = None, split: bool = False, decimals: int = 15,
               dialect: str = "ansi", calibrator=None, spark=None) -> str:
    """Model text; with ``path`` also written there as one text file through Spark."""
    text = sc.model_sql(round_model(model, decimals), split, dialect, calibrator=calibrator)
    if path is not None:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text
