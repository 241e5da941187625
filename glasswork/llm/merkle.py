"""A Merkle manifest of a dataset, and proofs by descent through its digests.

Every row is a leaf digest. Per source the leaves, by ascending id, are folded
in runs of three until one digest is left; the sources' digests, by name, are
folded likewise to the root. What is stored are records from a digest to its
children's digests.

A request names a leaf by its source's rank and its own. Descent starts at the
root and takes one digit (base 3) of a rank per level: the record of the
current digest gives the child to follow, and the other children go to the
proof. Five levels at a time are one step: requests that share a path share
its descent, so a step joins each stored segment of at most 3^5 leaves with the
requests below it. The path segments, top first, are reversed at the end.

Ranks come from a range partitioning with per-part offsets, so neither a hot
source nor a hot id meets in one task, and every step holds one segment at a
time. Records are looked up by digest inside the place of their segment:
copies of a subtree have equal digests and would meet in one key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glasswork.llm.inputs import importable, written

FANOUT = 3
# Levels per stored segment; 3^5 leaves below each.
LEVELS = 5
_SPAN = FANOUT**LEVELS
_SLICE = 1024
# One record: the digest of a node of the segment at (tree, step, place) and its children's digests joined.
_RECORDS = "tree long, step int, place long, digest string, children string"
_DIGEST = 64


def digest(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """The digest of a row's values: each ``-`` if null, else its UTF-8 length, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in
             (v.cast("string") for v in values)]
    return F.sha2(F.concat(*parts), 256)


def depth_of(nodes: Column) -> Column:
    """Levels above so many leaves until one digest is left."""
    powers = F.array(*[F.lit(FANOUT**e) for e in range(40)])
    return F.size(F.filter(powers, lambda p: p < nodes))


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (doc_id, source, tree, place, leaf, extra columns), ``sources`` (tree, source, n, depth, subroot),
    ``records`` of the sources' trees and ``top`` records of the tree over them; ``root`` is null without rows."""

    leaves: DataFrame
    sources: DataFrame
    records: DataFrame
    top: DataFrame
    top_depth: int
    root: str | None


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows with equal ``keys`` of a sorted partition, across batches."""
    now, rows = None, []
    for batch in batches:
        for a in range(0, batch.num_rows, _SLICE):
            for row in batch.slice(a, _SLICE).to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now:
                    if rows:
                        yield now, rows
                    now, rows = key, []
                rows.append(row)
    if rows:
        yield now, rows


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) >= _SLICE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


def _ranked(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``tree`` (rank of the group, from 0), ``place`` (rank in the group), ``n`` (its rows).

    Groups and rows run ascending, nulls first. Rows are dealt by range and
    numbered inside a part; what the parts hold, at most a row per part and
    group, gives the offsets.
    """
    spark = rows.sparkSession
    ordered = rows.withColumn("_group", F.col(by).cast("string"))
    keys = ["_group", *order]
    ordered = ordered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    names = ordered.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, groups, at, now = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            spots, which = [], []
            for value in batch["_group"].to_pylist():
                if groups < 0 or value != now:
                    groups, at, now = groups + 1, 0, value
                spots.append(at)
                which.append(groups)
                at += 1
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in names], pa.array([part] * len(spots), pa.int32()), pa.array(which, pa.int32()),
                 pa.array(spots, pa.int64())], names=[*names, "_part", "_which", "_at"])

    placed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema) + ", _part int, _which int, _at long"
    placed = written(ordered.mapInArrow(number, placed), "merkle-places")
    parts = placed.groupBy("_part", "_which", "_group").agg(F.count(F.lit(1)).alias("n"))
    along = W.partitionBy("_group").orderBy("_part")
    parts = parts.select(
        "_part", "_which", "_group", F.sum("n").over(W.partitionBy("_group")).alias("_n"),
        F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        (F.row_number().over(along) == 1).alias("_first"))
    # A part's groups that begin in it are numbered on from the parts before; one row per part is ordered here.
    begun = parts.groupBy("_part").agg(F.sum(F.col("_first").cast("long")).alias("b"), F.max((F.col("_which") == 0) & ~F.col("_first")).alias("held"))
    begun = begun.select(F.col("_part").alias("_p"), "held", F.coalesce(
        F.sum("b").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    parts = parts.join(begun, F.col("_part") == F.col("_p"))
    tree = F.max(F.when(F.col("_first"), F.col("before") + F.col("_which") - F.col("held").cast("int"))).over(W.partitionBy("_group"))
    parts = parts.select(F.col("_part").alias("_p"), F.col("_which").alias("_w"), tree.alias("tree"), "_start", F.col("_n").alias("n"))
    joined = placed.join(parts, (F.col("_part") == F.col("_p")) & (F.col("_which") == F.col("_w")))
    return joined.select(*rows.columns, F.col("tree").cast("long"), (F.col("_at") + F.col("_start")).alias("place"), "n")


def _folded(nodes: DataFrame, step: int) -> DataFrame:
    """Rows of two kinds from nodes (tree, place, digest, depth): records of step ``step``, and with null children the
    digest above each segment, whose ``place`` is its place one step up."""
    schema = pa.schema([("tree", pa.int64()), ("step", pa.int32()), ("place", pa.int64()), ("digest", pa.string()),
                        ("children", pa.string()), ("depth", pa.int32())])
    dealt = nodes.withColumn("seg", F.floor(F.col("place") / _SPAN).cast("long")).repartition("tree", "seg").sortWithinPartitions(
        "tree", "seg", "place")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (tree, seg), some in _runs(batches, ["tree", "seg"]):
                level, depth = [r["digest"] for r in some], some[0]["depth"]
                for _ in range(min(LEVELS, depth - step * LEVELS)):
                    joined = ["".join(level[i: i + FANOUT]) for i in range(0, len(level), FANOUT)]
                    level = [digest(c) for c in joined]
                    for d, c in zip(level, joined):
                        yield tree, step, seg, d, c, depth
                yield tree, step, seg, level[0], None, depth
        yield from _batches(rows(), schema)

    return written(dealt.mapInArrow(fold, _RECORDS + ", depth int"), "merkle-records")


def _build(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, (tree, digest) of each tree) of nodes (tree, place, digest, depth)."""
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    folded = _folded(nodes, 0)
    records = folded
    for step in range(1, -(-deepest // LEVELS)):
        # A tree that is through already passes its one digest on.
        folded = _folded(folded.filter("children IS NULL").select("tree", "place", "digest", "depth"), step)
        records = records.unionAll(folded)
    roots = folded.filter("children IS NULL").select("tree", "digest")
    return records.filter("children IS NOT NULL").select("tree", "step", "place", "digest", "children"), roots


def build_manifest(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", leaf_col: str = "leaf") -> Manifest:
    """The manifest of rows with their leaf digests; other columns travel with the leaves.

    Leaves of a source ascend by id (null ids first), rows with equal ids by
    digest; a null source is a source of its own and comes first. No rows give
    no records and no root.
    """
    spark = rows.sparkSession
    importable(spark)
    # Written first: texts are read once, and a row's number splits a hot id.
    numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-rows")
    ranked = _ranked(numbered, source_col, [id_col, leaf_col, "_row"]).drop("_row")
    leaves = written(ranked.withColumn("depth", depth_of(F.col("n")).cast("int")), "merkle-leaves")
    records, subroots = _build(leaves.select("tree", "place", F.col(leaf_col).alias("digest"), "depth"))
    named = leaves.filter("place = 0").select("tree", F.col(source_col).alias("source"), "n", "depth")
    sources = written(named.join(subroots.withColumnRenamed("digest", "subroot"), "tree"), "merkle-sources")
    top_depth = sources.agg(depth_of(F.count(F.lit(1))).cast("int")).first()[0]
    top, roots = _build(sources.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("digest"),
                                       F.lit(top_depth).alias("depth")))
    root = roots.first()
    return Manifest(leaves, sources, records, top, top_depth, root.digest if root else None)


_FRONTIER = "tree long, place long, digest string, path array<string>, depth int, subroot string"


def _descended(frontier: DataFrame, records: DataFrame, step: int, wanted: DataFrame) -> DataFrame:
    """One step down: a frontier row, and what it carries, for each of ``wanted`` (tree, place, carry).

    ``path`` holds, bottom level first, the unselected children of each level joined.
    """
    carry = wanted.schema["carry"].dataType
    types = {f.name: f.dataType for f in frontier.schema} | {"children": "string", "carry": carry}

    def part(kind: int, rows: DataFrame, seg: Column, *names: str) -> DataFrame:
        values = [F.col(n) if n in names else F.lit(None).cast(types[n]).alias(n) for n in (
            "place", "digest", "children", "path", "depth", "subroot", "carry")]
        return rows.select("tree", seg.cast("long").alias("seg"), F.lit(kind).alias("kind"), *values)

    # Per segment: its top with the path so far, its records, then the requests.
    parts = part(0, frontier, F.col("place"), "digest", "path", "depth", "subroot").unionAll(
        part(1, records.filter(F.col("step") == step), F.col("place"), "digest", "children")).unionAll(
        part(2, wanted, F.floor(F.col("place") / _SPAN), "place", "carry"))
    dealt = parts.repartition("tree", "seg").sortWithinPartitions("tree", "seg", "kind", "place")
    schema = pa.schema([("tree", pa.int64()), ("place", pa.int64()), ("digest", pa.string()), ("path", pa.list_(pa.string())),
                        ("depth", pa.int32()), ("subroot", pa.string()), ("carry", to_arrow_type(carry))])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (tree, _), some in _runs(batches, ["tree", "seg"]):
                top = some[0]
                if top["kind"]:
                    continue
                children = {r["digest"]: r["children"] for r in some if r["kind"] == 1}
                levels = min(LEVELS, top["depth"] - step * LEVELS)
                for r in some:
                    if r["kind"] < 2:
                        continue
                    current, path = top["digest"], []
                    for level in reversed(range(levels)):
                        at = _DIGEST * (r["place"] // FANOUT**level % FANOUT)
                        below = children[current]
                        current = below[at: at + _DIGEST]
                        path.append(below[:at] + below[at + _DIGEST:])
                    yield tree, r["place"], current, path[::-1] + top["path"], top["depth"], top["subroot"], r["carry"]
        yield from _batches(rows(), schema)

    return dealt.mapInArrow(descend, f"{_FRONTIER}, carry {carry.simpleString()}")


def _descent(starts: DataFrame, records: DataFrame, requests: DataFrame, deepest: int) -> DataFrame:
    """Frontier rows of the leaves that ``requests`` (tree, place, carry) name, from the trees' tops in ``starts``.

    Above the last step, requests that share a path are one.
    """
    frontier = starts
    for step in reversed(range(max(1, -(-deepest // LEVELS)))):
        if not step:
            return _descended(frontier, records, 0, requests)
        above = requests.select("tree", F.floor(F.col("place") / _SPAN**step).cast("long").alias("place")).distinct()
        frontier = written(_descended(frontier, records, step, above.withColumn("carry", F.lit(None).cast("int"))).drop("carry"),
                           "merkle-frontier")
    return frontier


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """Rows (tree, place, leaf, path, depth, subroot, carried columns), one per request (tree, place, any other columns).

    ``path`` holds the siblings of each level joined, bottom level first, up to
    the root. A request of a tree that the manifest has not is not answered;
    places must be those of leaves. A repeated request is answered each time.
    """
    spark = requests.sparkSession
    importable(spark)
    more = [c for c in requests.columns if c not in ("tree", "place")]
    carry = F.struct(*more) if more else F.lit(None).cast("int")
    root = [(0, 0, manifest.root, [], manifest.top_depth, None)] if manifest.root else []
    wanted = requests.select("tree").distinct().select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(None).cast("int").alias("carry"))
    reached = _descent(spark.createDataFrame(root, _FRONTIER), manifest.top, wanted, manifest.top_depth)
    starts = reached.select(F.col("place").alias("tree"), "digest", "path").join(manifest.sources.select("tree", "depth"), "tree")
    starts = written(starts.select("tree", F.lit(0).cast("long").alias("place"), "digest", "path", "depth",
                                   F.col("digest").alias("subroot")), "merkle-starts")
    deepest = starts.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    found = _descent(starts, manifest.records, requests.select("tree", "place", carry.alias("carry")), deepest)
    return found.select("tree", "place", F.col("digest").alias("leaf"), "path", "depth", "subroot", *(["carry.*"] if more else []))


def fold_proof(leaf: str, path: list[str], digits: Iterable[int]) -> str:
    """The root that a leaf and the siblings of each level give; the digits tell which child the path is."""
    for others, digit in zip(path, digits):
        at = _DIGEST * digit
        leaf = digest(others[:at], leaf, others[at:])
    return leaf


def fold(manifest: Manifest, proofs: DataFrame, leaf_col: str = "leaf") -> DataFrame:
    """``proofs`` without their paths, with ``proof_sha256`` (digest of all siblings in order) and ``folded_root``,
    what ``leaf_col`` and the siblings give: the manifest's root, unless the leaf is another one."""
    importable(proofs.sparkSession)
    kept = [c for c in proofs.columns if c != "path"]
    top_depth = manifest.top_depth

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(batch[c].to_pylist() for c in ("tree", "place", "depth", "path", "_claim")))
            proof, folded = [], []
            for tree, place, depth, path, leaf in columns:
                digits = [place // FANOUT**i % FANOUT for i in range(depth)] + [tree // FANOUT**i % FANOUT for i in range(top_depth)]
                proof.append(digest(*path))
                folded.append(fold_proof(leaf, path, digits))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(proof, pa.string()), pa.array(folded, pa.string())],
                                             names=[*kept, "proof_sha256", "folded_root"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema if f.name != "path")
    return proofs.withColumn("_claim", F.col(leaf_col)).mapInArrow(check, f"{schema}, proof_sha256 string, folded_root string")
