"""SQL text of model outputs: terms, sums, link functions and full SELECTs."""

from __future__ import annotations

import numpy as np

from glasswork.functions.sqltext import alias, case_axis, doubles, ident, label, number, searched_axis, string, whole_numbers
from glasswork.models import AdditiveModel, TreeModel

ZERO = number(0.0)
SOURCE = "<source_table>"


def outputs(model) -> list:
    """Class labels for a multiclass model, one unnamed output otherwise."""
    return list(model.classes) if model.task == "multiclass" else [None]


def suffix(cls) -> str:
    return "" if cls is None else f"_{cls}"


def term_text(term, output: int = 0, dialect: str = "spark", render=None) -> str:
    """CASE expression of a term; a pair nests the second axis inside the first."""
    render = render or (lambda scores: number(scores[output]))
    names = [ident(f, dialect) for f in term.features]
    if len(names) == 1:
        values = [render(term.scores[(i,)]) for i in range(len(term.axes[0]))]
        return case_axis(names[0], term.axes[0], values, render((0.0,) * _width(term)))
    zero = render((0.0,) * _width(term))
    inner = [
        case_axis(names[1], term.axes[1],
                  [render(term.scores[(i, j)]) for j in range(len(term.axes[1]))], zero)
        for i in range(len(term.axes[0]))
    ]
    return case_axis(names[0], term.axes[0], inner, zero)


def index_text(feature: str, axis, dialect: str = "spark") -> str:
    """Bin position, by CASE or by a search of a wide axis; nothing fitting gives the position after the last bin."""
    if dialect == "spark":
        inner = _inner(axis)
        null = next((i for i, c in enumerate(axis) if c.is_null), len(axis))
        wide = searched_axis(ident(feature), axis, lambda i: f"get({whole_numbers(inner)}, {i})", str(null), str(len(axis)))
        if wide:
            return wide
    return case_axis(ident(feature, dialect), axis, [str(i) for i in range(len(axis))], str(len(axis)))


def lookup_text(term, output: int = 0) -> str:
    """Spark form of a term: a pair reads one array at its two bin positions.

    A nested CASE of a fine grid would outgrow one generated method.
    """
    if len(term.features) == 1:
        return _searched(term, [output], lambda values: values[0]) or term_text(term, output)
    rows, cols = (len(a) for a in term.axes)
    grid = [
        number(term.scores[(i, j)][output]) if i < rows and j < cols else ZERO
        for i in range(rows + 1) for j in range(cols + 1)
    ]
    first, second = (index_text(f, a) for f, a in zip(term.features, term.axes))
    return f"array({', '.join(grid)})[({first}) * {cols + 1} + ({second})]"


def _inner(axis) -> list[int]:
    """Positions of the intervals in order, or of the categories by name: the order of a search."""
    places = [i for i, c in enumerate(axis) if not c.is_null]
    return sorted(places, key=lambda i: axis[i].category) if any(axis[i].category is not None for i in places) else places


def _searched(term, outputs_, join) -> str | None:
    """Spark form of a wide numeric term: bounds and scores as arrays, the outputs' values joined by ``join``."""
    axis = term.axes[0]
    inner = _inner(axis)
    null = next((term.scores[(i,)] for i, c in enumerate(axis) if c.is_null), (0.0,) * _width(term))

    def value(place: str) -> str:
        return join([f"get({doubles(term.scores[(i,)][k] for i in inner)}, {place})" for k in outputs_])

    return searched_axis(ident(term.features[0]), axis, value, join([number(null[k]) for k in outputs_]), join([ZERO for _ in outputs_]))


def _width(term) -> int:
    return len(next(iter(term.scores.values())))


def vector_text(term, dialect: str = "spark") -> str:
    """One lookup of a term that returns the scores of all classes as an array."""
    wide = len(term.features) == 1 and dialect == "spark" and _searched(
        term, range(_width(term)), lambda values: f"array({', '.join(values)})")
    return wide or term_text(term, dialect=dialect, render=lambda s: f"array({', '.join(map(number, s))})")


def contributions(model, dialect: str = "spark", portable: bool = False) -> list[tuple[str, str]]:
    """(alias, text) of every term contribution, classes in order; ``portable`` text runs in any warehouse."""
    out = []
    for k, cls in enumerate(outputs(model)):
        if isinstance(model, AdditiveModel):
            out += [(alias(f"{t.name}_score{suffix(cls)}"),
                     term_text(t, k, dialect) if portable else lookup_text(t, k)) for t in model.terms]
        else:
            out += [
                (alias(f"{f}_score{suffix(cls)}"), f"{number(c)} * {ident(f, dialect)}")
                for f, c in zip(model.features, model.coefficients[k])
            ]
    return out


def intercepts(model) -> list[tuple[str, str]]:
    return [
        (alias(f"intercept{suffix(cls)}"), number(model.intercept[k]))
        for k, cls in enumerate(outputs(model))
    ]


def sums(model) -> list[tuple[str, str]]:
    """Intercept plus contributions, per output."""
    names = [a for a, _ in contributions(model)]
    per = len(names) // len(outputs(model))
    out = []
    for k, (base, _) in enumerate(intercepts(model)):
        total = " + ".join([base, *names[k * per:(k + 1) * per]])
        cls = outputs(model)[k]
        out.append(("prediction" if model.task == "regression" else alias(f"score{suffix(cls)}"), total))
    return out


def sigmoid_text(score: str) -> str:
    return f"1E0 / (1E0 + EXP(-({score})))"


def link(model) -> list[list[tuple[str, str]]]:
    """Layers of (alias, text) that turn sums into probabilities and a label."""
    if model.task == "regression":
        return []
    if model.task == "binary":
        return [[("probability", sigmoid_text("score"))]]
    scores = [alias(f"score_{c}") for c in model.classes]
    top = [("max_score", f"GREATEST({', '.join(scores)})")]
    total = [("total_score", " + ".join(f"EXP({s} - max_score)" for s in scores))]
    probs = [
        (alias(f"probability_{c}"), f"EXP({s} - max_score) / total_score")
        for c, s in zip(model.classes, scores)
    ]
    whens = " ".join(f"WHEN {s} = max_score THEN {label(c)}" for c, s in zip(model.classes, scores))
    # GREATEST skips nulls; a null in any class score must give a null label.
    known = " AND ".join(f"{s} IS NOT NULL" for s in scores)
    pick = [("prediction", f"CASE WHEN {known} THEN CASE {whens} END END")]
    return [top, total, probs + pick]


def tree_text(model: TreeModel, leaf=None, dialect: str = "spark") -> str:
    """Nested CASE: ``x <= t`` goes left, everything else (null too) goes right."""
    nodes = {n.id: n for n in model.nodes}
    leaf = leaf or (lambda n: leaf_text(model, n))

    def walk(node):
        if node.feature is None:
            return leaf(node)
        return (
            f"CASE WHEN {ident(node.feature, dialect)} <= {number(node.threshold)} "
            f"THEN {walk(nodes[node.left])} ELSE {walk(nodes[node.right])} END"
        )

    return walk(model.nodes[0])


def leaf_text(model: TreeModel, node) -> str:
    if model.task == "regression":
        return number(node.value[0])
    return label(leaf_class(model, node))


def leaf_class(model: TreeModel, node):
    return model.classes[int(np.argmax(node.value))]


def leaf_share(node, k: int) -> str:
    total = sum(node.value)
    return number(node.value[k] / total if total else 0.0)


def model_sql(model, split: bool = False, dialect: str = "ansi", source: str = SOURCE,
              calibrator=None) -> str:
    """The model as one SELECT (lateral aliases) or, with ``split``, as CTE layers."""
    if isinstance(model, TreeModel):
        plain = f"SELECT\n{tree_text(model, dialect=dialect)}\nAS prediction"
        if calibrator is None or model.task != "binary":
            return f"{plain}\nFROM {source}"
        share = tree_text(model, lambda n: leaf_share(n, 1), dialect)
        return (f"SELECT prediction, probability\n, {calibrator.sql('probability')} AS calibrated_probability\n"
                f"FROM (\n{plain}\n, {share}\nAS probability\nFROM {source}\n) AS scored")
    first = [("model_name", string(model.name)), *intercepts(model), *contributions(model, dialect, portable=True)]
    layers = [sums(model), *link(model)]
    if calibrator is not None and model.task == "binary":
        layers.append([("calibrated_probability", calibrator.sql("probability"))])

    def items(pairs):
        return "\n, ".join(f"{text} AS {name}" for name, text in pairs)

    if not split:
        flat = [p for layer in [first, *layers] for p in layer]
        return f"SELECT\n{items(flat)}\nFROM {source}"
    names = ["terms", "summed", "with_max", "with_total", "with_probability"]
    parts = [f"{names[0]} AS (\nSELECT\n{items(first)}\nFROM {source}\n)"]
    for i, layer in enumerate(layers[:-1]):
        parts.append(f"{names[i + 1]} AS (\nSELECT *\n, {items(layer)}\nFROM {names[i]}\n)")
    last = f"SELECT *\n, {items(layers[-1])}\nFROM {names[len(layers) - 1]}"
    return "WITH " + ", ".join(parts) + "\n" + last

