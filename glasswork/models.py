"""Fitted models as plain data.

A model is a set of small tables whose size depends on features, bins and
classes, never on the number of rows it was fitted on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

INF = math.inf


@dataclass(frozen=True)
class Cell:
    """One bin of one axis: a missing-value bin, a category, or ``(lo, hi]``."""

    lo: float | None = None
    hi: float | None = None
    category: str | None = None
    is_null: bool = False


@dataclass(frozen=True)
class Term:
    """Shape function of one feature (one axis) or of a feature pair (two axes).

    ``scores`` maps the bin position (or pair of positions) to one value per
    output: a single value for regression and binary models, one per class
    for multiclass models.
    """

    features: tuple[str, ...]
    kinds: tuple[str, ...]
    axes: tuple[tuple[Cell, ...], ...]
    scores: dict[tuple[int, ...], tuple[float, ...]]
    stderr: dict[tuple[int, ...], tuple[float, ...]] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return "_x_".join(self.features)

    def transposed(self) -> "Term":
        return replace(
            self,
            features=self.features[::-1],
            kinds=self.kinds[::-1],
            axes=self.axes[::-1],
            scores={k[::-1]: v for k, v in self.scores.items()},
            stderr={k[::-1]: v for k, v in self.stderr.items()},
        )


@dataclass(frozen=True)
class AdditiveModel:
    name: str
    task: str  # regression | binary | multiclass
    target: str
    intercept: tuple[float, ...]
    terms: tuple[Term, ...]
    classes: tuple = ()

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(f for t in self.terms for f in t.features))


@dataclass(frozen=True)
class LinearModel:
    name: str
    task: str
    target: str
    features: tuple[str, ...]
    intercept: tuple[float, ...]
    coefficients: tuple[tuple[float, ...], ...]  # one row per output
    classes: tuple = ()


@dataclass(frozen=True)
class Node:
    """Tree node; a leaf has no ``feature``. ``value`` holds class weights or the mean."""

    id: int
    value: tuple[float, ...]
    rows: float = 0.0
    feature: str | None = None
    threshold: float | None = None
    left: int | None = None
    right: int | None = None
    gain: float = 0.0


@dataclass(frozen=True)
class TreeModel:
    name: str
    task: str
    target: str
    features: tuple[str, ...]
    nodes: tuple[Node, ...]
    classes: tuple = ()

    def node(self, node_id: int) -> Node:
        return {n.id: n for n in self.nodes}[node_id]

    @property
    def leaves(self) -> tuple[Node, ...]:
        return tuple(n for n in self.nodes if n.feature is None)


def numeric_axis(cuts, missing: bool = True) -> tuple[Cell, ...]:
    """Right-closed bins between consecutive cuts, after an optional null bin."""
    edges = [-INF, *cuts, INF]
    bins = tuple(Cell(lo=a, hi=b) for a, b in zip(edges, edges[1:]))
    return ((Cell(is_null=True),) if missing else ()) + bins


def category_axis(values, missing: bool = True) -> tuple[Cell, ...]:
    bins = tuple(Cell(category=v) for v in values)
    return ((Cell(is_null=True),) if missing else ()) + bins


def single_term(feature: str, kind: str, axis, scores, stderr=None) -> Term:
    """Term of one feature; ``scores`` is a list of numbers or of per-class tuples."""

    def rows(values):
        return {
            (i,): tuple(v) if isinstance(v, (tuple, list)) else (float(v),)
            for i, v in enumerate(values)
        }

    return Term((feature,), (kind,), (tuple(axis),), rows(scores), rows(stderr or []))


def pair_term(features, kinds, axes, grid) -> Term:
    scores = {
        (i, j): tuple(v) if isinstance(v, (tuple, list)) else (float(v),)
        for i, row in enumerate(grid)
        for j, v in enumerate(row)
    }
    return Term(tuple(features), tuple(kinds), tuple(tuple(a) for a in axes), scores)
