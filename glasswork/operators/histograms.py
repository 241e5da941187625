"""Sums over binned rows: per-bin gradients, curvature along directions, and pair grids.

A task folds its rows into vectors of bins with numpy and hands on one row per
bin it has seen; Spark adds these up by bin. What a pass returns therefore has
the size of bins times outputs, whatever the number of rows, features or pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glasswork.sources.session import importable

LEAST_CURVATURE = 1e-9
RIDGE = 1e-6
# A pair of features is ranked on a grid of at most so many cells; wider axes are coarsened.
PAIR_CELLS = 1_024
# Cells of all pair grids that a task holds at once (16 bytes each); more pairs take more passes.
GRID_CELLS = 2_000_000


@dataclass(frozen=True)
class Layout:
    """Where the bins of single features and of pairs lie in one flat vector.

    ``sizes`` holds the bins per column ``b0, b1, ..``, one of them for unseen
    categories; ``blocks`` names the columns of each term, one or two.
    """

    sizes: tuple[int, ...]
    blocks: tuple[tuple[int, ...], ...]

    @cached_property
    def lengths(self) -> list[int]:
        return [int(np.prod([self.sizes[c] for c in block])) for block in self.blocks]

    @cached_property
    def starts(self) -> list[int]:
        return [0, *np.cumsum(self.lengths).tolist()]

    @property
    def total(self) -> int:
        return self.starts[-1]

    def slice(self, block: int) -> slice:
        return slice(self.starts[block], self.starts[block + 1])

    def places(self, bins: list[np.ndarray]) -> list[np.ndarray]:
        """Per block the place of each row inside the block."""
        return [bins[b[0]] if len(b) == 1 else bins[b[0]] * self.sizes[b[1]] + bins[b[1]] for b in self.blocks]

    def sums(self, vector: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
        """Per output and row the sum of the row's entries in ``vector`` (outputs, total)."""
        out = np.zeros((len(vector), len(places[0])))
        for start, place in zip(self.starts, places):
            out += vector[:, start + place]
        return out


@dataclass(frozen=True)
class Fit:
    """A point of the fit: scores per output and bin, and what the loss needs."""

    task: str
    layout: Layout
    intercept: np.ndarray
    scores: np.ndarray

    @property
    def outputs(self) -> int:
        return len(self.scores)

    def rows(self, batch: pa.RecordBatch):
        """(weights, target sums, places, scores) of a batch of binned rows."""
        n = batch["n"].to_numpy()
        y = np.stack([batch[f"y{k}"].to_numpy() for k in range(self.outputs)])
        places = self.layout.places([batch[f"b{c}"].to_numpy().astype("i8") for c in range(len(self.layout.sizes))])
        return n, y, places, self.layout.sums(self.scores, places) + self.intercept[:, None]


def _mean(task: str, s: np.ndarray) -> np.ndarray:
    """Expected target per output: the score itself, or a probability."""
    if task == "regression":
        return s
    if task == "binary":
        return 1.0 / (1.0 + np.exp(-s))
    e = np.exp(s - s.max(axis=0))
    return e / e.sum(axis=0)


def _loss(task: str, n, y, s) -> float:
    """Summed loss up to a constant."""
    if task == "regression":
        return float((n * s * s - 2.0 * y * s).sum())
    if task == "binary":
        return float((n * np.logaddexp(0.0, s) - y * s).sum())
    top = s.max(axis=0)
    return float((n * (np.log(np.exp(s - top).sum(axis=0)) + top)).sum() - (y * s).sum())


def _curvature(task: str, n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    if task == "regression":
        return np.broadcast_to(n, mean.shape)
    return n * np.maximum(mean * (1.0 - mean), LEAST_CURVATURE)


def _product(task: str, n, mean, a, b) -> float:
    """Curvature of the loss between two directions given per output and row, outputs taken together."""
    if task == "multiclass":
        return float((n * ((mean * a * b).sum(axis=0) - (mean * a).sum(axis=0) * (mean * b).sum(axis=0))).sum())
    return float((_curvature(task, n, mean) * a * b).sum())


def _pass(rows: DataFrame, shared, function, schema: str, *aggregates) -> pa.Table:
    """Apply ``function(value, batches)`` to all rows with a broadcast value; the aggregated rows."""
    importable(rows.sparkSession)
    value = rows.sparkSession.sparkContext.broadcast(shared)
    out = rows.mapInArrow(lambda batches: function(value.value, batches), schema)
    out = out.groupBy(out.columns[0]).agg(*[F.sum(c).alias(c) for c in out.columns[1:]])
    try:
        return out.toArrow()
    finally:
        value.unpersist()


@dataclass(frozen=True)
class Histogram:
    """Loss, and per bag, output and bin the gradient and curvature; rows per bin."""

    loss: float
    gradient: np.ndarray
    curvature: np.ndarray
    weights: np.ndarray


def _fold(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fit, active, bags = shared
    layout, outputs = fit.layout, fit.outputs
    grad, curv = np.zeros((2, bags, outputs, layout.total))
    weights, loss = np.zeros((bags, layout.total)), 0.0
    for batch in batches:
        if not batch.num_rows:
            continue
        n, y, places, s = fit.rows(batch)
        mean = _mean(fit.task, s)
        loss += _loss(fit.task, n, y, s)
        g, h = y - n * mean, _curvature(fit.task, n, mean)
        bag = batch["bag"].to_numpy().astype("i8") if bags > 1 else 0
        for block in active:
            at, length = layout.slice(block), layout.lengths[block]
            place = bag * length + places[block]
            for k in range(outputs):
                grad[:, k, at] += np.bincount(place, g[k], bags * length).reshape(bags, length)
                curv[:, k, at] += np.bincount(place, h[k], bags * length).reshape(bags, length)
            weights[:, at] += np.bincount(place, n, bags * length).reshape(bags, length)
    counts = np.zeros_like(grad)
    counts[:, 0] = weights
    seen = np.flatnonzero(curv)
    columns = [np.append(seen, -1), *(np.append(x.ravel()[seen], last) for x, last in ((grad, loss), (curv, 0.0), (counts, 0.0)))]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "g", "h", "n"])


def histogram(rows: DataFrame, fit: Fit, active, bags: int = 1) -> Histogram:
    """One pass: the loss of all rows and the sums per bin of the ``active`` blocks, apart for each of ``bags``."""
    bags = max(bags, 1)
    found = _pass(rows, (fit, list(active), bags), _fold, "cell long, g double, h double, n double")
    cells = found["cell"].to_numpy()
    sums = {c: found[c].to_numpy() for c in "ghn"}
    real = cells >= 0
    flat = np.zeros((3, bags * fit.outputs * fit.layout.total))
    for row, c in zip(flat, "ghn"):
        row[cells[real]] = sums[c][real]
    grad, curv, counts = flat.reshape(3, bags, fit.outputs, fit.layout.total)
    return Histogram(float(sums["g"][~real].sum()), grad, curv, counts[:, 0].sum(axis=0))


def _measure(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fit, directions = shared
    count = len(directions)
    slope, curve = np.zeros(count), np.zeros((count, count))
    for batch in batches:
        if not batch.num_rows:
            continue
        n, y, places, s = fit.rows(batch)
        mean = _mean(fit.task, s)
        ways = [fit.layout.sums(d, places) for d in directions]
        for i, a in enumerate(ways):
            slope[i] += float(((y - n * mean) * a).sum())
            for j, b in enumerate(ways[:i + 1]):
                curve[i, j] += _product(fit.task, n, mean, a, b)
    sums = [*slope, *curve[np.tril_indices(count)]]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums, pa.float64())], names=["i", "v"])


def along(rows: DataFrame, fit: Fit, directions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One pass: slope of the loss along each direction (downhill is positive) and its curvature between them."""
    count = len(directions)
    found = _pass(rows, (fit, directions), _measure, "i long, v double")
    sums = np.zeros(count + count * (count + 1) // 2)
    sums[found["i"].to_numpy()] = found["v"].to_numpy()
    curve = np.zeros((count, count))
    curve[np.tril_indices(count)] = sums[count:]
    return sums[:count], np.maximum(curve, curve.T) if count == 1 else curve + np.tril(curve, -1).T


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain of the best four-way cut of a grid, from summed-area tables, and the Newton value of each cell."""
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    parts = []
    for area in (g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)):
        low = area[:-1, :-1]
        right, under = area[:-1, -1:] - low, area[-1:, :-1] - low
        parts.append((low, right, under, area[-1, -1] - low - right - under))
    gain = sum(x * x / (y + RIDGE) for x, y in zip(*parts))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = [float(x[i, j] / (y[i, j] + RIDGE)) for x, y in zip(*parts)]
    out = np.empty_like(g)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = value
    return float(gain[i, j]), out


def coarse_axes(weights: np.ndarray, order: np.ndarray, groups: int) -> np.ndarray:
    """Group of each bin: neighbours along ``order`` in at most ``groups`` groups of about equal weight."""
    if len(weights) <= groups:
        out = np.empty(len(order), "i8")
        out[order] = np.arange(len(order))
        return out
    along_ = weights[order]
    middle = np.cumsum(along_) - along_ / 2.0
    out = np.empty(len(order), "i8")
    out[order] = np.minimum((middle * groups / max(along_.sum(), 1e-300)).astype("i8"), groups - 1)
    return out


def _grids(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fit, pairs, axes = shared
    starts = np.cumsum([0, *[axes[p][0][1] * axes[p][1][1] for p in pairs]])
    grad, curv = np.zeros((2, starts[-1]))
    for batch in batches:
        if not batch.num_rows:
            continue
        n, y, _, s = fit.rows(batch)
        mean = _mean(fit.task, s)
        g, h = (y - n * mean)[0], _curvature(fit.task, n, mean)[0]
        for start, (a, b) in zip(starts, pairs):
            (by_a, size_a), (by_b, size_b) = axes[a, b]
            place = by_a[batch[f"b{a}"].to_numpy()] * size_b + by_b[batch[f"b{b}"].to_numpy()]
            at = slice(start, start + size_a * size_b)
            grad[at] += np.bincount(place, g, size_a * size_b)
            curv[at] += np.bincount(place, h, size_a * size_b)
    seen = np.flatnonzero(curv)
    which = np.searchsorted(starts, seen, "right") - 1
    first, second = np.array(pairs).T
    yield pa.RecordBatch.from_arrays(
        [pa.array(first[which]), pa.array(second[which]), pa.array(seen - starts[which]), pa.array(grad[seen]), pa.array(curv[seen])],
        names=["a", "b", "cell", "g", "h"])


def best_pairs(rows: DataFrame, fit: Fit, pairs: list[tuple[int, int]], weights: list[np.ndarray], orders: list[np.ndarray],
               count: int) -> list[tuple[int, int]]:
    """The ``count`` pairs of columns whose grids of the first output's gradient gain most by one four-way cut.

    Grids are summed and searched on executors; the driver gets ``count`` rows.
    ``weights`` and ``orders`` (rows per bin, and bins in order) serve to
    coarsen an axis where a grid would have more than ``PAIR_CELLS`` cells.
    """
    importable(rows.sparkSession)
    sizes, side = [len(w) for w in weights], int(PAIR_CELLS**0.5)

    def axis(c: int, other: int):
        groups = sizes[c] if sizes[c] * sizes[other] <= PAIR_CELLS else max(side, PAIR_CELLS // max(sizes[other], 1))
        by = coarse_axes(weights[c], orders[c], groups)
        return by, int(by.max()) + 1

    axes = {(a, b): (axis(a, b), axis(b, a)) for a, b in pairs}
    shapes = {p: (x[1], y[1]) for p, (x, y) in axes.items()}
    sc, parts, some, cells = rows.sparkSession.sparkContext, [], [], 0
    for p in pairs:
        some.append(p)
        cells += shapes[p][0] * shapes[p][1]
        if cells >= GRID_CELLS or p == pairs[-1]:
            value = sc.broadcast((fit, some, {q: axes[q] for q in some}))
            parts.append(rows.mapInArrow(lambda batches, value=value: _grids(value.value, batches),
                                         "a long, b long, cell long, g double, h double"))
            some, cells = [], 0
    known = sc.broadcast(shapes)

    def gain(key: tuple, table: pa.Table) -> pa.Table:
        a, b = (int(k.as_py()) for k in key)
        g, h = np.zeros((2, *known.value[a, b]))
        cell = table["cell"].to_numpy()
        g.flat[cell], h.flat[cell] = table["g"].to_numpy(), table["h"].to_numpy()
        return pa.table({"a": [a], "b": [b], "gain": [quadrants(g, h)[0]]})

    best = []
    for part in parts:
        summed = part.groupBy("a", "b", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        ranked = summed.groupBy("a", "b").applyInArrow(gain, "a long, b long, gain double")
        best += [(-r.gain, r.a, r.b) for r in ranked.orderBy(F.desc("gain"), "a", "b").limit(count).collect()]
    return [(a, b) for _, a, b in sorted(best)[:count]]
