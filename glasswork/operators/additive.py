"""Additive boosted models fitted by passes over binned rows.

Rows are binned once. A pass sums gradient and curvature per bin; every feature
then boosts small trees on its own bins, all features side by side. What they
propose together is one direction, which a second pass measures along with the
step before: the best point of the plane of both (a line search with
conjugation) accounts for features that go together, without any table over
pairs of bins. What the driver holds is some vectors of bins times classes, and
the method is the same at every size. Squared loss is quadratic, so its steps
are exact; for log losses a step that raises the loss is halved.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from glasswork.functions.hashing import hash_int, row_hash
from glasswork.models import AdditiveModel, Term
from glasswork.operators.binning import MAX_BINS, MAX_CATEGORIES, bin_features, bin_index, kind_of
from glasswork.operators.histograms import RIDGE, Fit, Histogram, Layout, along, best_pairs, histogram, quadrants
from glasswork.sources.checkpoint import cut_lineage
from glasswork.sources.session import with_small_methods

# Below this many bin combinations rows collapse to one weighted row per combination.
MAX_CELLS = 10_000_000
MAX_CLASSES = 1_000
PASSES = 40
# Grids of pairs have many cells for few rows each, so their boosting ends early.
PAIR_PASSES = 5
# Log losses: largest change of a bin's score per pass.
REACH = 2.0
# The passes end when one gains less than this share of all gains so far.
TOLERANCE = 1e-11


def target_classes(df: DataFrame, target: str, limit: int = MAX_CLASSES) -> tuple:
    """Distinct non-null labels in order; a classification target has few."""
    rows = df.filter(F.col(target).isNotNull()).select(target).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{target} has more than {limit} classes")
    return tuple(sorted(r[0] for r in rows))


def binned_rows(df: DataFrame, target: str, axes: dict, task: str, classes=(), bags: int = 1, keys=()) -> DataFrame:
    """Rows (b0, b1, .., n, y.., bag): bin positions, weight and target sums.

    A row's bag follows from its ``keys``, so equal rows fall into different
    bags; without keys, from its place in the table.

    With few possible combinations all equal rows collapse into one; the table
    is written once and read by every pass.
    """
    names = [f"b{i}" for i in range(len(axes))]
    place = hash_int(row_hash(keys, "bag")) if keys else F.xxhash64(F.monotonically_increasing_id())
    bag = F.pmod(place, F.lit(bags)).cast("int") if bags > 1 else F.lit(0)
    rows = with_small_methods(df).filter(F.col(target).isNotNull())
    if task == "regression":
        ys = [F.col(target).cast("double").alias("y0")]
    elif task == "binary":
        ys = [(F.col(target) == F.lit(classes[1])).cast("double").alias("y0")]
    else:
        ys = [(F.col(target) == F.lit(c)).cast("double").alias(f"y{k}") for k, c in enumerate(classes)]
    out = rows.select(*[bin_index(f, a).alias(n) for n, (f, a) in zip(names, axes.items())], *ys, bag.alias("bag"))
    combos = float(np.prod([len(a) + 1.0 for a in axes.values()])) * bags
    y_names = [f"y{k}" for k in range(len(ys))]
    if combos <= MAX_CELLS:
        out = out.groupBy(*names, "bag").agg(F.count("*").cast("double").alias("n"), *[F.sum(y).alias(y) for y in y_names])
    else:
        out = out.withColumn("n", F.lit(1.0))
    return cut_lineage(out)


def _small_trees(g: np.ndarray, h: np.ndarray, max_leaves: int) -> np.ndarray:
    """Newton values of one best-first regression tree per row, over ordered bins."""
    rows, width = g.shape
    each = np.arange(rows)
    cg, ch = (np.concatenate([np.zeros((rows, 1)), np.cumsum(x, axis=1)], axis=1) for x in (g, h))
    low, high = np.zeros((rows, width), int), np.full((rows, width), width)  # the part that holds each bin
    cuts = np.arange(1, width)
    for _ in range(max_leaves - 1):
        if width < 2:
            break
        # A cut before bin c divides the part of c, unless c begins it.
        lo, hi = low[:, 1:], high[:, 1:]
        left_g, left_h = cg[:, 1:-1] - np.take_along_axis(cg, lo, 1), ch[:, 1:-1] - np.take_along_axis(ch, lo, 1)
        right_g, right_h = np.take_along_axis(cg, hi, 1) - cg[:, 1:-1], np.take_along_axis(ch, hi, 1) - ch[:, 1:-1]
        gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - (left_g + right_g)**2 / (left_h + right_h + RIDGE)
        gain = np.where((left_h > 0) & (right_h > 0) & (lo < cuts), gain, -1.0)
        at = gain.argmax(axis=1)
        found = gain[each, at] > 0
        if not found.any():
            break
        cut = (at + 1)[:, None]
        part = (low == low[each, at + 1][:, None]) & found[:, None]
        before = np.arange(width) < cut
        high = np.where(part & before, cut, high)
        low = np.where(part & ~before, cut, low)
    return (np.take_along_axis(cg, high, 1) - np.take_along_axis(cg, low, 1)) / (
        np.take_along_axis(ch, high, 1) - np.take_along_axis(ch, low, 1) + RIDGE)


def _boosted(g: np.ndarray, h: np.ndarray, unordered: np.ndarray, rounds: int, rate: float, max_leaves: int) -> np.ndarray:
    """What ``rounds`` of small trees make of each row's own bins; unordered bins are sorted by their Newton value first."""
    value, left = np.zeros_like(g), g.copy()
    start = (g**2 / (h + RIDGE)).sum(axis=1)
    bins = np.broadcast_to(np.arange(g.shape[1]), g.shape)
    for _ in range(rounds):
        order = bins if not unordered.any() else np.where(
            unordered[:, None], np.argsort(np.where(h > 0, left / (h + RIDGE), np.inf), axis=1, kind="stable"), bins)
        tree = _small_trees(np.take_along_axis(left, order, 1), np.take_along_axis(h, order, 1), max_leaves)
        step = np.empty_like(tree)
        np.put_along_axis(step, order, rate * tree, 1)
        step[h <= 0] = 0.0
        value += step
        left -= h * step
        if ((h * step) ** 2 / (h + RIDGE)).sum() <= 1e-12 * start.sum():
            break
    return value


def _grid_boosted(g: np.ndarray, h: np.ndarray, orders, rounds: int, rate: float) -> np.ndarray:
    """The same for a grid of two features, by four-way cuts."""
    at = np.ix_(*orders)
    left, curv, value = g[at].copy(), h[at], np.zeros_like(g)
    for _ in range(rounds):
        gain, cells = quadrants(left, curv)
        if gain <= 0:
            break
        step = np.where(curv > 0, rate * cells, 0.0)
        value[at] += step
        left -= curv * step
    return value


class _Shapes:
    """How each active block turns its sums into a proposed change of its scores."""

    def __init__(self, layout: Layout, kinds: list[str], active, rounds: int, rate: float, max_leaves: int, orders=()):
        self.layout, self.rounds, self.rate, self.max_leaves, self.orders = layout, rounds, rate, max_leaves, orders
        self.single = [b for b in active if len(layout.blocks[b]) == 1]
        self.grids = [b for b in active if len(layout.blocks[b]) == 2]
        # The first bin is the missing one, the last one (unseen categories) stays 0.
        self.inner = [np.arange(layout.starts[b] + 1, layout.starts[b + 1] - 1) for b in self.single]
        self.unordered = np.array([kinds[layout.blocks[b][0]] == "categorical" for b in self.single], bool)

    def __call__(self, sums: Histogram) -> np.ndarray:
        grad, curv = sums.gradient[0], sums.curvature[0]
        out = np.zeros_like(grad)
        for k in range(len(grad)):
            g, h = grad[k], curv[k]
            if self.single:
                width = max(max(map(len, self.inner)), 1)
                gs, hs = np.zeros((2, len(self.single), width))
                for row, at in enumerate(self.inner):
                    gs[row, :len(at)], hs[row, :len(at)] = g[at], h[at]
                values = _boosted(gs, hs, self.unordered, self.rounds, self.rate, self.max_leaves)
                for row, (block, at) in enumerate(zip(self.single, self.inner)):
                    out[k, at] = values[row, :len(at)]
                    missing = self.layout.starts[block]
                    if h[missing] > 0:
                        out[k, missing] = g[missing] / (h[missing] + RIDGE)
            for block in self.grids:
                at, shape = self.layout.slice(block), [self.layout.sizes[c] for c in self.layout.blocks[block]]
                orders = [self.orders[c] for c in self.layout.blocks[block]]
                out[k, at] = _grid_boosted(g[at].reshape(shape), h[at].reshape(shape), orders, self.rounds, self.rate).ravel()
        return out


def _step(slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """The best multiples of the directions in the second-order model; the first one alone if they hardly differ."""
    if len(slope) == 2 and curve[1, 1] > 0 and np.linalg.det(curve) > 1e-9 * curve[0, 0] * curve[1, 1]:
        return np.linalg.solve(curve, slope)
    return np.array([slope[0] / curve[0, 0], *[0.0] * (len(slope) - 1)])


def _descend(rows: DataFrame, fit: Fit, shapes: _Shapes, active, passes: int, history: list | None = None) -> Fit:
    """The fit after at most ``passes`` steps of the active blocks; its loss never rises."""
    reach = np.inf if fit.task == "regression" else REACH
    accepted, start, best, last = fit, None, np.inf, None
    for done in range(passes + 1):
        sums = histogram(rows, fit, active)
        if sums.loss > best:
            if sums.loss - best <= TOLERANCE * (start - best):
                break
            # Overshot: go back half of the way and look again.
            fit = Fit(fit.task, fit.layout, fit.intercept, (accepted.scores + fit.scores) / 2)
            last = None if last is None else last / 2
            continue
        gained, accepted, best = best - sums.loss, fit, sums.loss
        start = best if start is None else start
        if history is not None:
            history.append(best)
        if done == passes or (start > best or gained <= 0) and gained <= TOLERANCE * (start - best):
            break
        proposed = np.clip(shapes(sums), -reach, reach)
        ways = [proposed] if last is None else [proposed, last]
        slope, curve = along(rows, fit, ways)
        if not (slope[0] > 0 and curve[0, 0] > 0):
            break
        move = sum(t * way for t, way in zip(_step(slope, curve), ways))
        last = move * min(1.0, reach / max(float(np.abs(move).max()), RIDGE))
        fit = Fit(fit.task, fit.layout, fit.intercept, fit.scores + last)
    return accepted


def _centered(fit: Fit, blocks, weights: np.ndarray) -> Fit:
    """Every block with a row-weighted mean of 0, which moves to the intercept; bins without rows score 0."""
    scores, intercept = fit.scores.copy(), fit.intercept.copy()
    for block in blocks:
        at = fit.layout.slice(block)
        w = weights[at]
        if w.sum() > 0:
            mean = scores[:, at] @ w / w.sum()
            scores[:, at] -= mean[:, None]
            scores[:, at][:, w <= 0] = 0.0
            intercept += mean
    return Fit(fit.task, fit.layout, intercept, scores)


def _jackknife(sums: Histogram) -> np.ndarray:
    """Standard error per output and bin from leaving out one bag at a time."""
    bags = len(sums.gradient)
    if bags < 2:
        return np.zeros(sums.gradient.shape[1:])
    g, h = sums.gradient, sums.curvature
    shift = (g.sum(axis=0) - g) / (h.sum(axis=0) - h + 1e-3)
    spread = ((shift - shift.mean(axis=0)) ** 2).sum(axis=0)
    return np.sqrt(spread * (bags - 1) / bags)


def fit_additive(df: DataFrame, target: str, features, task: str, name: str = "ebm", max_bins: int = MAX_BINS,
                 rounds: int = 200, learning_rate: float = 0.1, max_leaves: int = 3, passes: int | None = None,
                 interactions: int = 0, bags: int = 8, classes: tuple = (), history: list | None = None, keys=(),
                 max_classes: int = MAX_CLASSES, max_categories: int = MAX_CATEGORIES) -> AdditiveModel:
    """Fit shape functions (and ``interactions`` pair terms) for regression, binary or multiclass targets.

    Each of up to ``passes`` steps boosts ``rounds`` trees of ``max_leaves``
    leaves per feature at ``learning_rate``. ``history`` collects the summed
    loss of the accepted steps. Standard errors come from a jackknife over
    ``bags`` groups of rows, dealt out by ``keys``, the columns that identify a
    row. ``interactions`` are for regression and binary targets: the pairs
    whose residuals one four-way cut explains best, fitted together in at
    most ``PAIR_PASSES`` steps. More than
    ``max_classes`` classes or ``max_categories`` categories raise.
    """
    features = list(features)
    if interactions and task == "multiclass":
        raise ValueError("interactions are fitted for regression and binary targets only")
    classes = classes or (() if task == "regression" else target_classes(df, target, max_classes))
    axes = bin_features(df.select(*features), features, max_bins, max_categories=max_categories)
    outputs = len(classes) if task == "multiclass" else 1
    rows = binned_rows(df.select(*dict.fromkeys([*features, target, *keys])), target, axes, task, classes, bags, keys)
    kinds, passes = [kind_of(a) for a in axes.values()], PASSES if passes is None else passes
    layout = Layout(tuple(len(a) + 1 for a in axes.values()), tuple((c,) for c in range(len(axes))))
    first = rows.agg(F.sum("n"), *[F.sum(f"y{k}") for k in range(outputs)]).first()
    means = np.array([first[1 + k] or 0.0 for k in range(outputs)]) / (first[0] or 1.0)
    p = np.clip(means, 1e-6, 1 - 1e-6)
    intercept = {"regression": means, "binary": np.log(p / (1 - p)), "multiclass": np.log(p)}[task]
    active = range(len(axes))
    fit = Fit(task, layout, intercept, np.zeros((outputs, layout.total)))
    fit = _descend(rows, fit, _Shapes(layout, kinds, active, rounds, learning_rate, max_leaves), active, passes, history)
    sums = histogram(rows, fit, active, bags)
    stderr = _jackknife(sums)
    fit = _centered(fit, active, sums.weights)
    terms = [_term((f,), (a,), kinds[i:i + 1], fit, i, stderr) for i, (f, a) in enumerate(axes.items())]
    if interactions and len(features) > 1:
        fit, found = _with_pairs(rows, fit, kinds, sums.weights, interactions, rounds, learning_rate, passes)
        names = list(axes)
        terms += [_term((names[a], names[b]), (axes[names[a]], axes[names[b]]), (kinds[a], kinds[b]), fit, block)
                  for block, (a, b) in enumerate(found, len(axes))]
    return AdditiveModel(name, task, target, tuple(float(v) for v in fit.intercept), tuple(terms), tuple(classes))


def _with_pairs(rows: DataFrame, fit: Fit, kinds: list[str], weights: np.ndarray, count: int, rounds: int, rate: float, passes: int):
    """The fit with a grid for each of the best pairs, and these pairs; categories are ordered by their scores."""
    layout = fit.layout
    slices = [layout.slice(c) for c in range(len(kinds))]
    orders = [np.argsort(fit.scores[0, at], kind="stable") if kind == "categorical" else np.arange(at.stop - at.start)
              for kind, at in zip(kinds, slices)]
    pairs = best_pairs(rows, fit, list(combinations(range(len(kinds)), 2)), [weights[at] for at in slices], orders, count)
    wide = Layout(layout.sizes, (*layout.blocks, *pairs))
    scores = np.concatenate([fit.scores, np.zeros((1, wide.total - layout.total))], axis=1)
    active = range(len(kinds), len(wide.blocks))
    shapes = _Shapes(wide, kinds, active, rounds, rate, 0, orders)
    fit = _descend(rows, Fit(fit.task, wide, fit.intercept, scores), shapes, active, min(passes, PAIR_PASSES))
    return _centered(fit, active, histogram(rows, fit, active).weights), pairs


def _term(features, axes, kinds, fit: Fit, block: int, stderr: np.ndarray | None = None) -> Term:
    shape = [fit.layout.sizes[c] for c in fit.layout.blocks[block]]
    places = [tuple(map(int, at)) for at in np.ndindex(*map(len, axes))]

    def values(m: np.ndarray) -> dict:
        grid = m[:, fit.layout.slice(block)].reshape(-1, *shape)
        return {at: tuple(float(v) for v in grid[(slice(None), *at)]) for at in places}

    return Term(tuple(features), tuple(kinds), tuple(map(tuple, axes)), values(fit.scores), {} if stderr is None else values(stderr))
