"""Exact k nearest neighbours inside groups, without comparing all pairs.

Points are laid on a space-filling curve and cut into blocks of bounded size.
Neighbours inside the own block give every point an upper bound on its k-th
distance; only blocks whose bounding box lies within that bound are compared.
Which ones these are is found by a join down two trees of boxes, level by
level: a pair of nodes is opened only if some point of the one may have a
neighbour in the other. The bound makes the result exact, whatever the curve
does. A task holds two blocks at a time, whatever the size of a group.

Equal rows of a group are one point that holds its smallest keys, so copies at
distance zero fill no blocks and are not compared with each other.
"""

from __future__ import annotations

from functools import reduce
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from glasswork.operators.ranks import row_positions
from glasswork.sources.checkpoint import cut_lineage

BLOCK = 512
# Children of a node in the tree of boxes.
FANOUT = 8
_CURVE_BITS, _CURVE_AXES = 60, 6


def _curve_key(axes, spans: dict) -> Column:
    """Interleaved bits of up to six axes, each scaled to its range in the whole table.

    More axes are first folded into six sums of all of them with fixed signs,
    so that each has a say in the place on the curve.
    """
    shares = {a: (F.col(a) - F.lit(spans[a][0])) / F.lit((spans[a][1] - spans[a][0]) or 1.0) for a in axes}
    used = list(shares.values())
    if len(used) > _CURVE_AXES:
        signs = [[1.0 if crc32(f"{i}|{a}".encode()) & 1 else -1.0 for a in axes] for i in range(_CURVE_AXES)]
        # A sum of n shares with signs lies between -n and n.
        used = [sum((s * F.lit(g) for s, g in zip(shares.values(), row)), F.lit(0.0)) / F.lit(2.0 * len(axes)) + F.lit(0.5) for row in signs]
    bits = _CURVE_BITS // len(used)
    cells = []
    for share in used:
        cells.append(F.least(F.floor(share * F.lit(float(2**bits))), F.lit(2**bits - 1)).cast("bigint"))
    parts = [
        F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("bigint")), b * len(used) + i)
        for b in range(bits) for i, c in enumerate(cells)
    ]
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def _distances(x, y, cx, cy, cost):
    """Squared distances, one axis at a time; ``cost`` is added once per differing category."""
    d = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T):
        d += (a[:, None] - b[None, :]) ** 2
    for j in range(cx.shape[1] if cx.size else 0):
        d += cost * (cx[:, None, j] != cy[None, :, j])
    return d


def _arrays(pdf: pd.DataFrame):
    x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, 0))
    c = np.stack(pdf["c"].to_numpy()) if len(pdf) and len(pdf["c"].iloc[0]) else np.zeros((len(pdf), 0))
    return x.astype(float), c


def _nearest(d, ids, k):
    """Per row the positions of the k smallest finite distances, ties by id."""
    by_id = np.argsort(ids, kind="stable")
    order = by_id[np.argsort(d[:, by_id], axis=1, kind="stable")[:, :k]]
    known = np.isfinite(np.take_along_axis(d, order, 1)).sum(axis=1)
    return [row[:n] for row, n in zip(order, known)]


def nearest(df: DataFrame, key: str, axes, k: int = 5, by=(), cats=(), cost: str | None = None,
            block: int = BLOCK) -> DataFrame:
    """Rows (``by``..., key, neighbors): up to k other rows of the group as (distance, key) by distance.

    ``axes`` are numeric and without nulls; ``cats`` differ at a squared
    ``cost`` (a column, equal inside a group) each. ``key`` is unique.
    """
    by, axes, cats = list(by), list(axes), list(cats)
    spot = [f"_a{i}" for i in range(len(axes))] + [f"_c{i}" for i in range(len(cats))]
    rows = df.select(*by, F.col(key).alias("_id"), *[F.col(a).cast("double").alias(n) for a, n in zip(axes, spot)], *[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(cats, spot[len(axes):])],
        (F.col(cost) if cost else F.lit(0.0)).alias("_cost"))
    # Of a point's rows only the k + 1 smallest keys can be a neighbour of any row; the limit holds before the shuffle.
    place = F.row_number().over(W.partitionBy(*by, *spot).orderBy("_id"))
    few = rows.withColumn("_place", place).filter(F.col("_place") <= k + 1)
    points = few.groupBy(*by, *spot).agg(F.first("_cost").alias("_cost"), F.array_sort(F.collect_list("_id")).alias("_ids"))
    points = cut_lineage(points.withColumn("_id", F.get("_ids", F.lit(0))))
    # A row before a neighbour by (distance, key) has a point before it by (distance, smallest key), so k points are enough.
    near = _nearest_points(points, "_id", spot[: len(axes)], k, by, spot[len(axes):], "_cost", block)
    met = near.select(F.col("_id").alias("_of"), F.explode("neighbors").alias("_nb")).select(
        "_of", "_nb.distance", F.col("_nb.id").alias("_id")).join(points.select("_id", "_ids"), "_id")
    met = met.groupBy("_of").agg(F.collect_list(F.struct("distance", "_ids")).alias("_met"))
    # A row that is not finite has no distance to its copies either.
    finite = reduce(Column.__and__, [F.abs(F.col(n)) < float("inf") for n in spot[: len(axes)]])
    own = F.when(finite, F.array(F.struct(F.lit(0.0).alias("distance"), "_ids")))
    parts = F.concat(*[F.coalesce(c, F.array().cast(met.schema["_met"].dataType)) for c in (own, F.col("_met"))])
    pairs = F.flatten(F.transform(parts, lambda p: F.transform(
        p["_ids"], lambda i: F.struct(p["distance"].alias("distance"), i.alias("id")))))
    listed = points.withColumnRenamed("_id", "_of").join(met, "_of", "left").select(
        *by, *spot, F.slice(F.array_sort(pairs), 1, k + 1).alias("_list"))
    listed = listed.select(*[F.col(c).alias(f"_p{c}") for c in (*by, *spot)], "_list")
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_p{c}")) for c in (*by, *spot)])
    others = F.slice(F.filter("_list", lambda s: s["id"] != F.col("_id")), 1, k)
    return rows.join(listed, on).select(*by, F.col("_id").alias(key), others.alias("neighbors"))


def _nearest_points(df: DataFrame, key: str, axes, k: int, by, cats, cost: str, block: int) -> DataFrame:
    """What ``nearest`` returns, for rows that all differ."""
    pts = df.select(*by, F.col(key).alias("id"), *[F.col(a).cast("double").alias(a) for a in axes], *cats,
                    F.col(cost).alias("cost"))
    span = pts.agg(*[f(a).alias(f"{n}{i}") for i, a in enumerate(axes) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if span["lo0"] is None:
        return df.limit(0).select(*by, key, F.array(F.struct(F.lit(0.0).alias("distance"), F.col(key).alias("id"))).alias("neighbors"))
    spans = {a: (span[f"lo{i}"], span[f"hi{i}"]) for i, a in enumerate(axes)}
    ranked = row_positions(pts.withColumn("_z", _curve_key(axes, spans)), "_z", ["id"], by)
    # Every block has at least ``block`` points (the last one up to twice that), or is the whole group.
    last = F.greatest(F.floor(F.col("group_rows") / block) - 1, F.lit(0))
    blocks = ranked.select(
        *by, "id", "cost", F.least(F.floor(F.col("position") / block), last).alias("block"),
        F.array(*axes).alias("x"),
        (F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cats]) if cats
         else F.array().cast("array<string>")).alias("c"))
    id_type = dict(blocks.dtypes)["id"]
    by_ddl = "".join(f"`{b}` {dict(blocks.dtypes)[b]}, " for b in by)
    found = f"near array<struct<distance: double, id: {id_type}>>"

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        x, c = _arrays(pdf)
        ids, cost_ = pdf["id"].to_numpy(), float(pdf["cost"].iloc[0])
        d = _distances(x, x, c, c, cost_)
        np.fill_diagonal(d, np.inf)
        near = _nearest(d, ids, k)
        out = pdf[[*by, "id", "cost", "block", "x", "c"]].copy()
        out["u"] = [float(row[p[-1]]) if len(p) == k else float("inf") for row, p in zip(d, near)]
        out["near"] = [[(float(row[j]), ids[j]) for j in p] for row, p in zip(d, near)]
        return out

    schema = f"{by_ddl} id {id_type}, cost double, block bigint, x array<double>, c array<string>, u double, {found}"
    first = cut_lineage(blocks.groupBy(*by, "block").applyInPandas(local, schema))

    pairs = _block_pairs(first, by, len(axes))
    mine = first.select(*by, "block", "id", "x", "c", "cost", "u").join(pairs, [*by, "block"])
    # Fresh column names, so that the two sides of the cogroup are told apart.
    theirs = first.select(*by, F.col("block").alias("other"), F.col("id").alias("oid"), F.col("x").alias("ox"),
                          F.col("c").alias("oc")).join(pairs, [*by, "other"])
    theirs = theirs.select(*[F.col(n).alias(f"_{n}") for n in theirs.columns])

    def across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in [*by, "id", "near"]})
        (x, cx), (y, cy) = _arrays(left), _arrays(right.rename(columns={"_ox": "x", "_oc": "c"}))
        ids = right["_oid"].to_numpy()
        d = _distances(x, y, cx, cy, float(left["cost"].iloc[0]))
        d[d > left["u"].to_numpy()[:, None]] = np.inf
        near = _nearest(d, ids, k)
        out = left[[*by, "id"]].copy()
        out["near"] = [[(float(row[j]), ids[j]) for j in p] for row, p in zip(d, near)]
        return out[out["near"].map(len) > 0]

    link = [*by, "block", "other"]
    right_link = [f"_{n}" for n in link]
    more = mine.groupBy(*link).cogroup(theirs.groupBy(*right_link)).applyInPandas(across, f"{by_ddl} id {id_type}, {found}")
    both = first.select(*by, "id", "near").unionByName(more)
    # At most k candidates per compared block reach this step.
    best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    merged = both.groupBy(*by, "id").agg(best.alias("near"))
    root = F.transform("near", lambda s: F.struct(F.sqrt(s["distance"]).alias("distance"), s["id"].alias("id")))
    return merged.select(*by, F.col("id").alias(key), root.alias("neighbors"))


def _box(prefix: str, dims: int):
    return [f(F.get("x", F.lit(i))).alias(f"{prefix}{n}{i}") for i in range(dims)
            for n, f in (("lo", F.min), ("hi", F.max))]


def _merge_boxes(dims: int):
    return [f(f"{n}{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]


def _gap(a: str, b: str, dims: int) -> Column:
    """Squared distance between two boxes held in columns ``{a}lo0``.. and ``{b}lo0``.."""
    total = F.lit(0.0)
    for i in range(dims):
        apart = F.greatest(F.col(f"{a}lo{i}") - F.col(f"{b}hi{i}"), F.col(f"{b}lo{i}") - F.col(f"{a}hi{i}"), F.lit(0.0))
        total = total + apart * apart
    return total


def _block_pairs(first: DataFrame, by, dims: int) -> DataFrame:
    """Pairs (block, other) that may hold neighbours, by a join down the trees of boxes.

    A node of level ``l`` stands for ``FANOUT^l`` neighbouring blocks. From the
    top, every pair of nodes whose boxes are within the left one's bound is
    replaced by the pairs of their children. A pair is met by its two parents'
    names, so no step compares all boxes and no row holds them.
    """
    names = [f"{n}{i}" for i in range(dims) for n in ("lo", "hi")]
    boxes = cut_lineage(first.groupBy(*by, "block").agg(*_box("", dims), F.max("u").alias("u")))
    top = boxes.agg(F.max("block")).first()[0] or 0
    levels = 0
    while FANOUT**levels <= top:
        levels += 1

    def nodes(level: int) -> DataFrame:
        size = FANOUT**level
        merged = boxes.groupBy(*by, F.floor(F.col("block") / size).cast("bigint").alias("node")).agg(*_merge_boxes(dims), F.max("u").alias("u"))
        return merged.withColumn("up", F.floor(F.col("node") / FANOUT).cast("bigint"))

    def side(level: int, prefix: str, node: str, up: str) -> DataFrame:
        rows = nodes(level)
        return rows.select(*by, F.col("node").alias(node), F.col("up").alias(up), F.col("u").alias(f"{prefix}u"),
                           *[F.col(n).alias(f"{prefix}{n}") for n in names])

    pairs = nodes(levels).select(*by, F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(range(levels)):
        left, right = side(level, "l", "na", "a"), side(level, "r", "nb", "b")
        opened = pairs.join(left, [*by, "a"]).join(right, [*by, "b"]).filter(_gap("l", "r", dims) <= F.col("lu"))
        pairs = cut_lineage(opened.select(*by, F.col("na").alias("a"), F.col("nb").alias("b")))
    return pairs.filter("a <> b").select(*by, F.col("a").alias("block"), F.col("b").alias("other"))
