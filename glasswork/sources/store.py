"""Model store: lookup tables as Parquet, metadata as JSON, both through Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from glasswork.models import AdditiveModel, Cell, LinearModel, Node, Term, TreeModel

_CELL = "kind{0} string, lo{0} double, hi{0} double, category{0} string, is_null{0} boolean"
LOOKUP_SCHEMA = (
    "model_id string, term_no int, feature string, feature2 string, position int, position2 int, "
    + _CELL.format("") + ", " + _CELL.format("2") + ", scores array<double>, stderr array<double>"
)
LINEAR_SCHEMA = "model_id string, output int, feature_no int, feature string, coefficient double"
TREE_SCHEMA = (
    "model_id string, id int, value array<double>, rows double, feature string, "
    "threshold double, `left` int, `right` int, gain double"
)


def lookup_rows(model: AdditiveModel) -> list[tuple]:
    out = []
    for no, term in enumerate(model.terms):
        second = len(term.features) == 2
        for pos, scores in term.scores.items():
            a = term.axes[0][pos[0]]
            b = term.axes[1][pos[1]] if second else Cell()
            out.append((
                model.name, no, term.features[0], term.features[1] if second else None,
                pos[0], pos[1] if second else None,
                term.kinds[0], a.lo, a.hi, a.category, a.is_null,
                term.kinds[1] if second else None, b.lo, b.hi, b.category, b.is_null,
                list(scores), list(term.stderr.get(pos, ())),
            ))
    return out


def extract_lookup(spark: SparkSession, model: AdditiveModel) -> DataFrame:
    """The model as a table: one row per bin or pair of bins."""
    return spark.createDataFrame(lookup_rows(model), LOOKUP_SCHEMA)


def _terms(rows) -> tuple[Term, ...]:
    terms: dict[int, list] = {}
    for r in rows:
        terms.setdefault(r["term_no"], []).append(r)
    out = []
    for no in sorted(terms):
        cells = terms[no]
        second = cells[0]["feature2"] is not None
        axis = {r["position"]: Cell(r["lo"], r["hi"], r["category"], r["is_null"]) for r in cells}
        axes, kinds, names = [axis], [cells[0]["kind"]], [cells[0]["feature"]]
        if second:
            axes.append({r["position2"]: Cell(r["lo2"], r["hi2"], r["category2"], r["is_null2"]) for r in cells})
            kinds.append(cells[0]["kind2"])
            names.append(cells[0]["feature2"])

        def pos(r):
            return (r["position"], r["position2"]) if second else (r["position"],)

        out.append(Term(
            tuple(names), tuple(kinds), tuple(tuple(a[i] for i in sorted(a)) for a in axes),
            {pos(r): tuple(r["scores"]) for r in cells},
            {pos(r): tuple(r["stderr"]) for r in cells if r["stderr"]},
        ))
    return tuple(out)


def save_model(spark: SparkSession, model, path: str) -> None:
    if isinstance(model, AdditiveModel):
        kind, rows, schema = "additive", lookup_rows(model), LOOKUP_SCHEMA
    elif isinstance(model, LinearModel):
        kind, schema = "linear", LINEAR_SCHEMA
        rows = [
            (model.name, k, i, f, c)
            for k, coefs in enumerate(model.coefficients)
            for i, (f, c) in enumerate(zip(model.features, coefs))
        ]
    else:
        kind, schema = "tree", TREE_SCHEMA
        rows = [
            (model.name, n.id, list(n.value), n.rows, n.feature, n.threshold, n.left, n.right, n.gain)
            for n in model.nodes
        ]
    meta = {
        "kind": kind, "name": model.name, "task": model.task, "target": model.target,
        "features": list(model.features), "classes": list(model.classes),
        "intercept": list(getattr(model, "intercept", ())),
    }
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/table")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str):
    """Read a saved model back; only model-sized tables are collected."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    rows = spark.read.parquet(f"{path}/table").collect()
    head = {k: meta[k] for k in ("name", "task", "target")}
    classes, intercept = tuple(meta["classes"]), tuple(meta["intercept"])
    if meta["kind"] == "additive":
        return AdditiveModel(**head, intercept=intercept, terms=_terms(rows), classes=classes)
    if meta["kind"] == "linear":
        rows = sorted(rows, key=lambda r: (r["output"], r["feature_no"]))
        outputs = sorted({r["output"] for r in rows})
        coefs = tuple(tuple(r["coefficient"] for r in rows if r["output"] == k) for k in outputs)
        return LinearModel(**head, features=tuple(meta["features"]), intercept=intercept,
                           coefficients=coefs, classes=classes)
    nodes = tuple(
        Node(r["id"], tuple(r["value"]), r["rows"], r["feature"], r["threshold"], r["left"], r["right"], r["gain"])
        for r in sorted(rows, key=lambda r: r["id"])
    )
    return TreeModel(**head, features=tuple(meta["features"]), nodes=nodes, classes=classes)
