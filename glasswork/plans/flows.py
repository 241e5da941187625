"""End-to-end flows: table to model, saved model on a new table, messy table to clean table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from inspect import signature

from pyspark.sql import DataFrame, SparkSession, functions as F

from glasswork.functions.sqltext import label, number
from glasswork.operators import clean, evaluate as ev, explain, profile, resample, splits
from glasswork.operators.additive import fit_additive, target_classes
from glasswork.operators.association import association
from glasswork.operators.calibrate import calibrate
from glasswork.operators.linear import FOLD_FEATURES, cross_fit_linear, fit_linear, fit_logistic, null_feature_rows
from glasswork.operators.score import export_sql, predict, probability_columns
from glasswork.operators.tree import fit_tree
from glasswork.plans.options import Options
from glasswork.sources.checkpoint import cut_lineage
from glasswork.sources.tables import DEFAULT_NULLS, nullify, read_table, write_clean

MODELS = ("ebm", "l_regression", "decision_tree")
# Parameter names that configurations use for what has another name here.
PARAMETER_NAMES = {
    "ebm": {"max_rounds": "rounds", "outer_bags": "bags"},
    "l_regression": {},
    "decision_tree": {"min_samples_leaf": "min_rows", "min_impurity_decrease": "min_gain", "random_state": "seed"},
}


def model_params(kind: str, learner, params: dict) -> dict:
    """``params`` under the learner's own names; one that it does not know raises and tells those it does."""
    own = [n for n in signature(learner).parameters if n not in ("df", "target", "features", "task", "classes", "keys", "name")]
    renamed = {PARAMETER_NAMES[kind].get(n, n): v for n, v in params.items()}
    unknown = sorted(set(renamed) - {*own, "classes", "keys", "name"})
    if unknown:
        raise ValueError(f"{kind} has no parameter {', '.join(unknown)}; it knows {', '.join(sorted([*own, *PARAMETER_NAMES[kind]]))}")
    return renamed


def fit(df: DataFrame, kind: str, target: str, features, task: str, classes: tuple = (), params: dict | None = None,
        keys=()):
    """Fit one of the three model kinds; ``task`` is regression or classification, ``keys`` identify a row."""
    params = dict(params or {})
    if kind not in MODELS:
        raise ValueError(f"unknown model {kind}; choose from {MODELS}")
    if task == "classification":
        classes = classes or target_classes(df, target)
        params["classes"] = classes
    exact = task if task == "regression" else ("binary" if len(classes) == 2 else "multiclass")
    linear = fit_linear if task == "regression" else fit_logistic
    params = model_params(kind, {"ebm": fit_additive, "decision_tree": fit_tree}.get(kind, linear), params)
    if kind == "ebm":
        return fit_additive(df, target, features, exact, **{"keys": tuple(keys)} | params)
    if kind == "decision_tree":
        return fit_tree(df, target, features, exact, **params)
    # Rows with a null feature have no linear score; ``Run.null_rows`` tells how many were left out.
    params.setdefault("nulls", "drop")
    return linear(df, target, features, **params)


def build_folds(df: DataFrame, options: Options, keys, task: str) -> DataFrame:
    """The table with ``fold`` and ``is_oot``: one copy, whatever the number of folds.

    Time series: fold 0 is only trained on, fold i is tested after training on
    earlier ones. Otherwise every fold is tested against all others.
    """
    out = df
    if options.oot_rows:
        out = splits.oot_holdout(out, options.time_column, keys, options.oot_rows, options.seed)
    else:
        out = out.withColumn("is_oot", F.lit(False))
    inside, outside = out.filter(~F.col("is_oot")), out.filter("is_oot")
    if options.time_series:
        folded = splits.time_blocks(inside, options.time_column, keys, seed=options.seed).withColumnRenamed("block", "fold")
    elif task == "classification":
        folded = splits.stratified_kfold(inside, options.target, keys, seed=options.seed)
    else:
        folded = splits.kfold(inside, keys, seed=options.seed)
    folded = folded.withColumn("fold", F.col("fold").cast("int"))
    if not options.oot_rows:
        return folded
    return folded.unionByName(outside.withColumn("fold", F.lit(None).cast("int")))


def _train_rows(df: DataFrame, options: Options, features, keys, task: str) -> DataFrame:
    """Training rows, balanced when asked for; with ``max_cells`` folds and the final table are trimmed alike first."""
    if not options.upsampling or task != "classification":
        return df
    if options.max_cells:
        df = resample.trim_classes(df, options.target, keys, len(features), options.max_cells, seed=options.seed)
    return resample.upsample(df, options.target, features, keys, task, seed=options.seed)


def _fit_calibrated(df: DataFrame, kind: str, options: Options, features, keys, task: str, classes):
    """Model and, for binary targets with calibration on, a calibrator fitted on held-out rows."""
    wanted = options.calibration if task == "classification" and len(classes) == 2 else None
    held = None
    if wanted:
        marked = splits.calibration_split(df, keys)
        df, held = marked.filter(~F.col("is_calibration")), marked.filter("is_calibration")
    rows = _train_rows(df, options, features, keys, task)
    # Upsampled rows are copies or blends without keys of their own.
    own = () if options.upsampling and task == "classification" else keys
    model = fit(rows, kind, options.target, features, task, classes, options.model_params, own)
    if held is None:
        return model, None
    scored = predict(held, model).select(
        (F.col(options.target) == F.lit(classes[1])).cast("int").alias("y"), F.col("probability").alias("p"))
    return model, calibrate(scored, method=wanted)


def apply_model(df: DataFrame, model, calibrator=None) -> DataFrame:
    """Predictions; a calibrator replaces the probability and the label that follows from it."""
    out = predict(df, model)
    if calibrator is None:
        return out
    zero, one = model.classes
    pick = F.expr(f"CASE WHEN probability > {number(0.5)} THEN {label(one)} "
                  f"WHEN probability IS NOT NULL THEN {label(zero)} END")
    return out.withColumn("probability", calibrator.column("probability")).withColumn("prediction", pick)


def cross_fit(folded: DataFrame, fit_fold, time_series: bool = False) -> DataFrame:
    """Out-of-fold predictions: ``fit_fold(train)`` gives (model, calibrator) for each fold's test rows.

    Only fold numbers reach the driver; the folds are filters over one table.
    """
    numbers = sorted(r[0] for r in folded.filter("fold IS NOT NULL").select("fold").distinct().collect())
    parts = []
    for k in [n for n in numbers if not time_series or n > 0]:
        train = folded.filter(F.col("fold") < k if time_series else F.col("fold") != k)
        model, calibrator = fit_fold(train)
        parts.append(apply_model(folded.filter(F.col("fold") == k), model, calibrator))
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Run:
    model: object
    calibrator: object
    task: str
    features: tuple
    predictions: DataFrame
    tables: dict = field(default_factory=dict)
    associations: DataFrame | None = None
    sql: str = ""
    null_rows: int = 0


def run(df: DataFrame, config: dict, kind: str, keys) -> Run:
    """Check, clean, split, cross-fit, fit, evaluate and export a model.

    ``keys`` identify a row. Evaluation rows carry ``data_type``: train
    (in-sample, final model), test (out of fold) and oot. Tables are lazy.
    """
    options = Options.from_config(config, [c for c in df.columns if c not in keys])
    features = [f for f in options.features if f not in keys]
    profile.require_target(df, options.target)
    df = clean.drop_null_target(df, options.target)
    task = profile.infer_task(df, options.target)
    kinds = dict(df.dtypes)
    # Dates, intervals and nested values are no features; a boolean target counts as 0 and 1.
    features = [f for f in features if profile.is_feature_type(kinds[f])]
    extra = [c for c in [*keys, options.time_column] if c]
    df = nullify(df.select(*dict.fromkeys([*extra, *features, options.target])), ())
    if kinds[options.target] == "boolean":
        df = df.withColumn(options.target, F.col(options.target).cast("int"))
    cleaned, features = clean.clean_pipeline(df, options.target, features, kind, task)
    if options.max_rows:
        cleaned = splits.limit_rows(cleaned, keys, options.max_rows, options.seed)
    # Every later step reads this table, so it is written once.
    folded = cut_lineage(build_folds(cleaned, options, keys, task))
    train = folded.filter(~F.col("is_oot"))
    classes = target_classes(train, options.target) if task == "classification" else ()

    def fit_fold(rows):
        return _fit_calibrated(rows, kind, options, features, keys, task, classes)

    params = model_params(kind, fit_linear, options.model_params) if kind == "l_regression" and task == "regression" else None
    if params is not None and len(features) <= FOLD_FEATURES and set(params) <= {"alpha"}:
        calibrator = None
        model, tested = cross_fit_linear(train, options.target, features, time_series=options.time_series, **params)
    else:
        # Every fit reads the table; a checkpoint is decoded row by row each time, a cache by column.
        folded.persist()
        try:
            tested = cross_fit(train, fit_fold, options.time_series)
            model, calibrator = _fit_calibrated(train, kind, options, features, keys, task, classes)
        finally:
            folded.unpersist()
    parts = [
        apply_model(train, model, calibrator).withColumn("data_type", F.lit("train")),
        tested.withColumn("data_type", F.lit("test")),
    ]
    if options.oot_rows:
        held = folded.filter("is_oot")
        parts.append(apply_model(held, model, calibrator).withColumn("data_type", F.lit("oot")))
    predictions = reduce(DataFrame.unionByName, parts)
    text = export_sql(model, split=options.sql_split, decimals=options.sql_decimals, calibrator=calibrator)
    return Run(model, calibrator, task, tuple(features), predictions, tables(predictions, model),
               association(train, features, keys), text,
               null_feature_rows(train, features) if kind == "l_regression" else 0)


def tables(predictions: DataFrame, model) -> dict[str, DataFrame]:
    """Evaluation tables of predictions that carry ``data_type``; out-of-fold rows with their ``fold`` also per fold."""
    columns = probability_columns(model)
    labels = list(model.classes) if len(columns) > 1 else list(model.classes[1:2])
    fold = "fold" if "fold" in predictions.columns and model.task != "regression" else None
    if fold:
        predictions = predictions.withColumn(fold, F.when(F.col("data_type") == "test", F.col(fold)))
    return ev.evaluate(predictions, model.task, model.target, dict(zip(labels, columns)),
                       n_features=len(model.features), fold=fold)


def check_model(model, df: DataFrame, keys, calibrator=None, rows: int | None = 10) -> tuple[dict, DataFrame]:
    """Evaluation tables of a saved model on a new table, and explanations of some rows."""
    df = nullify(df, ())
    scored = apply_model(df, model, calibrator).withColumn("data_type", F.lit("test"))
    return tables(scored, model), explain.explain_rows(df, model, keys, rows)


def clean_data(spark: SparkSession, path: str, fmt: str = "csv", out: str | None = None) -> str:
    """Read a table, apply the cleaning rules and write it next to the input as ``_processed``."""
    raw = read_table(spark, path, DEFAULT_NULLS, typed=False)
    out = out or path.removesuffix(".csv").removesuffix(".parquet") + "_processed"
    write_clean(clean.quick_clean(raw), out, fmt)
    return out
