"""Probability calibration; a fitted calibrator is a small expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from glasswork.functions.scoring import sigmoid_text
from glasswork.functions.sqltext import doubles, number, search
from glasswork.operators.ranks import bucket_count, range_bucket
from glasswork.sources.session import importable

# Above this many calibration rows ``auto`` picks isotonic regression.
ISOTONIC_ROWS = 1_000
# Largest error that joining blocks of almost equal values may bring into an isotonic curve; for
# targets from 0 to 1 a stack then holds at most levels / tolerance blocks.
ISOTONIC_TOLERANCE = 1e-6
# Above this many knots a curve is applied by a search, below it by nested CASE.
CASE_KNOTS = 64
_MERGED = 16
_STACK = "lo double, hi double, s double, n double"


@dataclass(frozen=True)
class Platt:
    """Logistic curve of the predicted probability."""

    slope: float
    intercept: float

    def sql(self, column: str) -> str:
        return sigmoid_text(f"{number(self.slope)} * {column} + {number(self.intercept)}")

    def expression(self, column: str) -> str:
        return self.sql(column)

    def column(self, column: str) -> Column:
        return F.expr(self.expression(column))


@dataclass(frozen=True)
class Isotonic:
    """Piecewise linear, non-decreasing; constant outside the fitted range."""

    xs: tuple[float, ...]
    ys: tuple[float, ...]

    def sql(self, column: str) -> str:
        return f"CASE WHEN {column} IS NULL THEN NULL ELSE {self._range(column, 0, len(self.xs))} END"

    def _range(self, c: str, lo: int, hi: int) -> str:
        """Text for the part between knots lo-1 and hi, halved until one piece is left."""
        if lo == hi:
            if lo == 0:
                return number(self.ys[0])
            if lo == len(self.xs):
                return number(self.ys[-1])
            x0, x1, y0, y1 = self.xs[lo - 1], self.xs[lo], self.ys[lo - 1], self.ys[lo]
            if y0 == y1 or x0 == x1:
                return number(y1)
            return f"{number(y0)} + ({c} - {number(x0)}) * {number((y1 - y0) / (x1 - x0))}"
        mid = (lo + hi) // 2
        return (f"CASE WHEN {c} <= {number(self.xs[mid])} THEN {self._range(c, lo, mid)} "
                f"ELSE {self._range(c, mid + 1, hi)} END")

    def expression(self, column: str) -> str:
        """Spark text: a long curve is searched, ``y + slope * (p - x)`` of the knot at or above p."""
        if len(self.xs) <= CASE_KNOTS:
            return self.sql(column)
        xs, ys = np.array(self.xs), np.array(self.ys)
        gap = np.diff(xs)
        slope = np.divide(np.diff(ys), gap, out=np.zeros(len(gap)), where=gap > 0)
        # Piece i ends at knot i; the first and the last piece are flat.
        base, at, slopes = [ys[0], *ys[:-1], ys[-1]], [xs[0], *xs[:-1], xs[-1]], [0.0, *slope, 0.0]
        flat = f"get({doubles(slopes)}, i) = 0E0"
        line = f"get({doubles(base)}, i) + get({doubles(slopes)}, i) * ({column} - get({doubles(at)}, i))"
        piece = f"if({flat}, get({doubles([*ys, ys[-1]])}, i), {line})"
        place = search(f"cast({column} AS double)", doubles(xs), len(xs))
        return f"CASE WHEN {column} IS NULL THEN NULL ELSE transform(array({place}), i -> {piece})[0] END"

    def column(self, column: str) -> Column:
        return F.expr(self.expression(column))


def _weighted(df: DataFrame, y: str, p: str) -> DataFrame:
    """Rows (p, y, n): one per distinct score and label, so copies shuffle once."""
    return df.select(F.col(p).alias("p"), F.col(y).cast("double").alias("y")).dropna().groupBy("p", "y").agg(
        F.count("*").cast("double").alias("n"))


def platt_calibrate(df: DataFrame, y: str = "y", p: str = "p", C: float = 1.0) -> Platt:
    rows = _weighted(df, y, p)
    total = rows.agg(F.sum("n")).first()[0] or 1.0
    vectors = VectorAssembler(inputCols=["p"], outputCol="_features").transform(rows)
    fit = LogisticRegression(featuresCol="_features", labelCol="y", weightCol="n", regParam=1.0 / (C * total),
                             standardization=False, family="binomial").fit(vectors)
    return Platt(float(fit.coefficients[0]), float(fit.intercept))


def _pooled(lo: np.ndarray, hi: np.ndarray, s: np.ndarray, n: np.ndarray, slack: float) -> list[np.ndarray]:
    """Blocks in order after pooling neighbours that violate monotony; a run of values within ``slack`` is one block."""
    stack: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), s.tolist(), n.tolist()):
        now = list(block)
        while stack and stack[-1][2] * now[3] >= now[2] * stack[-1][3]:
            before = stack.pop()
            now = [before[0], now[1], before[2] + now[2], before[3] + now[3]]
        stack.append(now)
    kept: list[list[float]] = []
    least = 0.0
    for now in stack:
        if kept and slack > 0 and now[2] / now[3] - least <= slack:
            kept[-1] = [kept[-1][0], now[1], kept[-1][2] + now[2], kept[-1][3] + now[3]]
        else:
            kept.append(now)
            least = now[2] / now[3]
    return [np.array(c, float) for c in zip(*kept)] if kept else [np.zeros(0)] * 4


def isotonic_calibrate(df: DataFrame, y: str = "y", p: str = "p", tolerance: float = ISOTONIC_TOLERANCE) -> Isotonic:
    """Monotone regression as a stack of pooled blocks, merged in a tree over ranges of scores.

    Pooling may start anywhere: blocks pooled inside a range stay together in
    the whole, so stacks of neighbouring ranges merge exactly. Each level joins
    blocks whose values differ by no more than its share of ``tolerance``; as
    monotone regression never moves further than its data, the curve is off by
    ``tolerance`` at most (0: exact). Only the last merge, of blocks alone, is
    one task; its knots are the model.
    """
    importable(df.sparkSession)
    rows = _weighted(df, y, p).groupBy("p").agg(F.sum(F.col("y") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    rows = rows.select(F.col("p").cast("double").alias("p"), "s", "n")
    groups, levels = 2 * bucket_count(rows) + 2, 1
    while _MERGED**levels < groups:
        levels += 1
    slack = tolerance / (levels + 1)

    def pool(table: pa.Table) -> pa.Table:
        table = table.sort_by("lo")
        columns = _pooled(*(table[c].to_numpy() for c in ("lo", "hi", "s", "n")), slack)
        return pa.table([pa.array(np.full(len(columns[0]), table["_bucket"][0].as_py(), "i8")), *map(pa.array, columns)],
                        names=["_bucket", "lo", "hi", "s", "n"])

    placed = range_bucket(rows, "p")
    stacks = placed.select(F.col("_bucket").cast("long").alias("_bucket"), F.col("p").alias("lo"), F.col("p").alias("hi"), "s", "n")
    for _ in range(levels):
        stacks = stacks.groupBy("_bucket").applyInArrow(pool, f"_bucket long, {_STACK}")
        stacks = stacks.withColumn("_bucket", F.floor((F.col("_bucket") + 1) / _MERGED).cast("long"))
    last = stacks.withColumn("_bucket", F.lit(0).cast("long")).groupBy("_bucket").applyInArrow(pool, f"_bucket long, {_STACK}")
    knots = last.toArrow().sort_by("lo")
    lo, hi, s, n = (knots[c].to_numpy() for c in ("lo", "hi", "s", "n"))
    value = s / n
    single = lo == hi
    xs = np.stack([lo, hi], axis=1)[np.stack([np.ones_like(single), ~single], axis=1)]
    return Isotonic(tuple(xs.tolist()), tuple(np.repeat(value, np.where(single, 1, 2)).tolist()))


def calibrate(df: DataFrame, y: str = "y", p: str = "p", method: str = "auto"):
    """``sigmoid``, ``isotonic``, or by row count with ``auto``."""
    if method == "auto":
        method = "isotonic" if df.limit(ISOTONIC_ROWS + 1).count() > ISOTONIC_ROWS else "sigmoid"
    if method not in ("sigmoid", "isotonic"):
        raise ValueError(f"unknown calibration method: {method}")
    return isotonic_calibrate(df, y, p) if method == "isotonic" else platt_calibrate(df, y, p)
