"""Approximate nearest neighbours on a graph built by NN-descent.

Equal vectors are one node, so a vector that a third of all rows share is no
hub. Random sign buckets give every node first neighbours. Then each round joins
every node's neighbours, and a bounded sample of the nodes it is a neighbour of,
with their vectors; all of them are compared with each other, as neighbours of
neighbours, and every node keeps its nearest. Only pairs that are nearer than the
farthest neighbour of a full list leave a hood, since no other can improve it.

A query starts from its own node and from some entry points all over the table, and
walks the graph greedily: it expands the nearest nodes that it has not expanded
yet and keeps the nearest it has met, until none of those is left to expand. All
queries walk together, one Spark job per step. Every node also has some links to
nodes at random, since the nearest alone leave close groups shut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from glasswork.llm.inputs import importable, written

NEIGHBOURS = 40
REVERSE = 20
ROUNDS = 4
TABLES = 3
BUCKET = 64
# A list this long leads a walk to its neighbours; the fewer nodes a step expands, the fewer it expands in vain.
BEAM = 384
EXPAND = 64
# Entry points of a walk, however many nodes there are.
ENTRIES = 32
# Links of a node to nodes at random, on average.
LONG = 4
# Nodes whose lists one task handles at once, and pairs of a query block.
BLOCK = 1024
QUERY_BLOCK = 20_000
_GRAPH = "src long, dst long, dist float"


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, v array of double): null, zero and non-finite vectors and null ids are left out, repeated rows are one.

    Vectors of another length than the most frequent one cannot be compared and are left out too.
    """
    importable(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0].d if lengths else 0)).distinct()


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """Rows (node, v, ids): one per distinct vector with its ``keep`` smallest ids, gathered over salted levels."""
    n = rows.count()
    salts = max(1, n // 1000)
    out = rows.select("v", F.array("id").alias("ids"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    while True:
        # A group holds about a thousand lists of at most ``keep`` ids, even if all vectors are equal.
        out = out.groupBy("v", "salt").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))
        if salts == 1:
            return written(out.select(F.monotonically_increasing_id().alias("node"), "v", "ids"), "nodes")
        salts = max(1, salts // 100)
        out = out.withColumn("salt", F.pmod("salt", F.lit(salts)))


def _packed(nodes: DataFrame) -> DataFrame:
    """Rows (node, vec): vectors as float32 bytes, for the search; scores come from the originals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(v, "<f4").tobytes() for v in batch["v"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(packed, pa.binary())], names=["node", "vec"])

    return written(nodes.select("node", "v").mapInArrow(run, "node long, vec binary"), "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _nearest_of_all(table: pa.Table, keep: int) -> pa.Table:
    """Rows (hood, node, vec) to each member's ``keep`` nearest in its hood. A hood is bounded, a table holds some of them.

    With a column ``reach``, the members nearer than that instead, however many they are; null takes all.
    """
    hood, node = table["hood"].to_numpy(), table["node"].to_numpy()
    order = np.argsort(hood, kind="stable")
    vec, node = _matrix(table["vec"].combine_chunks())[order], node[order]
    reach = table["reach"].fill_null(np.inf).to_numpy()[order] if "reach" in table.column_names else None
    cuts = np.flatnonzero(np.diff(hood[order], prepend=hood[order][0] - 1)) if len(order) else np.zeros(0, int)
    out = []
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        if b - a < 2:
            continue
        d = _distances(vec[a:b], vec[a:b])
        np.fill_diagonal(d, np.inf)
        if reach is not None:
            one, other = np.nonzero(d < reach[a:b, None])
            out.append((node[a:b][one], node[a:b][other], d[one, other]))
            continue
        k = min(keep, b - a - 1)
        near = np.argpartition(d, k - 1, 1)[:, :k]
        out.append((np.repeat(node[a:b], k), node[a:b][near].ravel(), np.take_along_axis(d, near, 1).ravel()))
    src, dst, dist = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "f4"))
    return pa.table({"src": src, "dst": dst, "dist": dist.astype("f4")})


def _keep_nearest(table: pa.Table, keep: int) -> pa.Table:
    """The ``keep`` nearest distinct neighbours of every source in a table."""
    src, dst, dist = table["src"].to_numpy(), table["dst"].to_numpy(), table["dist"].to_numpy()
    order = np.lexsort((dst, src))
    src, dst, dist = src[order], dst[order], dist[order]
    fresh = np.ones(len(src), bool)
    fresh[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
    src, dst, dist = src[fresh], dst[fresh], dist[fresh]
    order = np.lexsort((dst, dist, src))
    src, dst, dist = src[order], dst[order], dist[order]
    first = np.flatnonzero(np.diff(src, prepend=src[0] - 1)) if len(src) else np.zeros(0, int)
    rank = np.arange(len(src)) - np.repeat(first, np.diff(np.append(first, len(src))))
    return pa.table({"src": src[rank < keep], "dst": dst[rank < keep], "dist": dist[rank < keep]})


def _hoods(packed: DataFrame, members: DataFrame, keep: int, blocks: int) -> DataFrame:
    """Compare the members (hood, node) of every hood with each other; see ``_nearest_of_all``."""
    rows = members.join(packed, "node").withColumn("block", F.pmod(F.xxhash64("hood"), F.lit(blocks)))

    def compare(table: pa.Table) -> pa.Table:
        return _nearest_of_all(table, keep)

    return rows.groupBy("block").applyInArrow(compare, _GRAPH)


def _merged(pairs: DataFrame, keep: int, blocks: int) -> DataFrame:
    def cut(table: pa.Table) -> pa.Table:
        return _keep_nearest(table, keep)

    return written(pairs.withColumn("block", F.pmod(F.xxhash64("src"), F.lit(blocks))).groupBy("block").applyInArrow(cut, _GRAPH), "graph")


def _sign_buckets(packed: DataFrame, bits: int, table: int) -> DataFrame:
    """Rows (bucket, node): the signs of ``bits`` random projections around a common centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(batch["vec"])
            planes = np.random.default_rng(1000 + table).normal(size=(x.shape[1], bits))
            sign = (x @ planes > 0).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sign), batch["node"]], names=["bucket", "node"])

    return packed.mapInArrow(run, "bucket long, node long")


def first_graph(packed: DataFrame, n: int, keep: int, blocks: int) -> DataFrame:
    """Neighbours inside sign buckets of about ``BUCKET`` nodes; a larger bucket is dealt into several at random."""
    bits = max(1, int(np.ceil(np.log2(max(2, n / BUCKET)))))
    found = None
    for t in range(TABLES):
        placed = written(_sign_buckets(packed, min(bits, 62), t), "buckets")
        sizes = placed.groupBy("bucket").agg(F.ceil(F.count("node") / (2 * BUCKET)).alias("parts"))
        hoods = placed.join(sizes, "bucket").select(
            F.xxhash64("bucket", F.pmod(F.xxhash64("node", F.lit(t)), "parts"), F.lit(t)).alias("hood"), "node")
        # Small buckets leave nodes alone, so each node also meets a random group.
        random = placed.select(F.xxhash64(F.pmod(F.xxhash64("node", F.lit(-t - 1)), F.lit(max(1, n // BUCKET))), F.lit(-t - 1)).alias("hood"), "node")
        pairs = _hoods(packed, hoods.unionAll(random), keep, blocks)
        found = pairs if found is None else found.unionAll(pairs)
    return _merged(found, keep, blocks)


def with_reverse(graph: DataFrame, reverse: int) -> DataFrame:
    """Rows (src, dst): every neighbour, and at most ``reverse`` of the nodes a node is a neighbour of, nearest first.

    The bound is the method's sample: a node that many point to does not have to
    point back to all of them, and they still point to it.
    """
    back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    # A hub's list is cut in slices first, so no task sorts all of it.
    for part in (["src", F.pmod(F.xxhash64("dst"), F.lit(64))], ["src"]):
        ranked = F.row_number().over(W.partitionBy(*part).orderBy("dist", "dst"))
        back = back.withColumn("place", ranked).filter(F.col("place") <= reverse).drop("place")
    return graph.select("src", "dst").unionAll(back.select("src", "dst")).distinct()


def with_reach(packed: DataFrame, graph: DataFrame, keep: int) -> DataFrame:
    """Packed vectors with ``reach``: the distance of the farthest neighbour of a node whose list is full."""
    full = F.when(F.count("dst") >= keep, F.max("dist"))
    return packed.join(graph.groupBy(F.col("src").alias("node")).agg(full.alias("reach")), "node", "left")


def long_links(packed: DataFrame, n: int, each: int = LONG) -> DataFrame:
    """Rows (src, dst): about ``each`` nodes at random for every node, from groups of about ``each + 1`` by a hash."""
    hood = F.pmod(F.xxhash64("node", F.lit("long")), F.lit(max(1, n // (each + 1))))
    return packed.select(hood.alias("hood"), F.col("node").alias("src")).join(
        packed.select(hood.alias("hood"), F.col("node").alias("dst")), "hood").filter("src != dst").select("src", "dst")


def starts(queries: DataFrame, packed: DataFrame, n: int, entries: int = ENTRIES) -> DataFrame:
    """Rows (query, node): every query's own node, whose links lead to its neighbours, and entry points common to all."""
    stride = max(1, n // entries)
    common = packed.filter(F.pmod(F.xxhash64("node"), F.lit(stride)) == 0).select("node")
    return queries.select("query", F.col("query").alias("node")).unionAll(
        queries.select("query").crossJoin(F.broadcast(common))).distinct()


def build_graph(nodes: DataFrame, neighbours: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(packed vectors, graph rows (src, dst, dist)) by NN-descent over rows (node, v)."""
    packed = _packed(nodes)
    n = packed.count()
    blocks = max(1, -(-n // BLOCK))
    graph = first_graph(packed, n, neighbours, blocks)
    for _ in range(rounds if n > 2 else 0):
        both = with_reverse(graph, reverse)
        members = both.select(F.col("src").alias("hood"), F.col("dst").alias("node")).unionAll(
            packed.select(F.col("node").alias("hood"), "node"))
        graph = _merged(graph.unionAll(_hoods(with_reach(packed, graph, neighbours), members, neighbours, blocks)), neighbours, blocks)
    return packed, graph


def _start(query: int, vec: bytes) -> dict:
    return {"query": query, "vec": vec, "ids": b"", "dists": b"", "open": b"", "seen": b""}


_STATE = "query long, vec binary, ids binary, dists binary, open binary, seen binary"


def _step(left: pa.Table, right: pa.Table, beam: int) -> dict:
    """A query's state after it met the nodes of ``right``: its nearest so far, which are still open, all it has seen."""
    state = {c: left[c][0].as_py() for c in ("query", "vec", "ids", "dists", "open", "seen")}
    ids, dists, open_ = (np.frombuffer(state[c], t) for c, t in (("ids", "<i8"), ("dists", "<f4"), ("open", "?")))
    met, d = right["node"].to_numpy(), right["dist"].to_numpy()
    met, first = np.unique(met, return_index=True)
    ids, dists = np.concatenate([ids, met]), np.concatenate([dists, d[first]])
    open_ = np.concatenate([open_, np.ones(len(met), bool)])
    order = np.lexsort((ids, dists))[:beam]
    seen = np.union1d(np.frombuffer(state["seen"], "<i8"), met)
    return state | {"ids": ids[order].astype("<i8").tobytes(), "dists": dists[order].astype("<f4").tobytes(),
                    "open": open_[order].tobytes(), "seen": seen.astype("<i8").tobytes()}


def search(queries: DataFrame, packed: DataFrame, links: DataFrame, first: DataFrame, keep: int, beam: int = BEAM,
           expand: int = EXPAND) -> DataFrame:
    """Rows (query, node): the ``keep`` nodes nearest to rows (query, vec) that the walks have met.

    ``links`` holds rows (src, dst), ``first`` the nodes (query, node) each walk starts from. A query's state is one row of bounded lists;
    a step joins the nodes it expands with the graph, and the new ones with their
    vectors.
    """
    adjacency = written(links.groupBy("src").agg(F.collect_list("dst").alias("to")), "adjacency")
    few = queries.count() <= QUERY_BLOCK

    def measure(pairs: DataFrame, state: DataFrame) -> DataFrame:
        asked = state.select("query", F.col("vec").alias("asked"))
        both = pairs.join(packed, "node").join(F.broadcast(asked) if few else asked, "query")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    gap = _matrix(batch["vec"]) - _matrix(batch["asked"])
                    yield pa.RecordBatch.from_arrays([batch["query"], batch["node"], pa.array((gap * gap).sum(1))], names=["query", "node", "dist"])

        return both.select("query", "node", "vec", "asked").mapInArrow(run, "query long, node long, dist float")

    def advance(state: DataFrame, met: DataFrame) -> DataFrame:
        def update(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.Table.from_pylist([_step(left, right, beam)] if left.num_rows else [], _ARROW_STATE)

        return written(state.groupBy("query").cogroup(met.groupBy("query")).applyInArrow(update, _STATE), "walk")

    def frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                ids, open_ = np.frombuffer(s["ids"], "<i8"), np.frombuffer(s["open"], "?")
                chosen = ids[np.flatnonzero(open_)[:expand]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chosen), s["query"])), pa.array(chosen)], names=["query", "src"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for s in rows:
                open_ = np.frombuffer(s["open"], "?").copy()
                open_[np.flatnonzero(open_)[:expand]] = False
                s["open"] = open_.tobytes()
            yield pa.RecordBatch.from_pylist(rows, _ARROW_STATE)

    def unseen(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})
        met = np.unique(right["to"].combine_chunks().flatten().to_numpy())
        new = np.setdiff1d(met, np.frombuffer(left["seen"][0].as_py(), "<i8"), assume_unique=True)
        return pa.table({"query": np.full(len(new), left["query"][0].as_py()), "node": new})

    none = F.lit(b"")
    state = queries.select("query", "vec", none.alias("ids"), none.alias("dists"), none.alias("open"), none.alias("seen"))
    state = advance(state, measure(first, state))
    while state.filter(F.instr(F.hex("open"), "01") > 0).limit(1).count():
        going = state.mapInArrow(frontier, "query long, src long")
        reached = going.join(adjacency, "src").select("query", "to")
        new = state.groupBy("query").cogroup(reached.groupBy("query")).applyInArrow(unseen, "query long, node long")
        state = advance(state.mapInArrow(close, _STATE), measure(new, state))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                ids = np.frombuffer(s["ids"], "<i8")[:keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), s["query"])), pa.array(ids)], names=["query", "node"])

    return state.mapInArrow(spread, "query long, node long")


_ARROW_STATE = pa.schema([("query", pa.int64()), ("vec", pa.binary()), ("ids", pa.binary()), ("dists", pa.binary()),
                          ("open", pa.binary()), ("seen", pa.binary())])


def nearest(df: DataFrame, query_filter: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            neighbours: int = NEIGHBOURS, rounds: int = ROUNDS, beam: int = BEAM) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found for the rows that ``query_filter`` (over ``id``) takes.

    All rows but those with the query's own id are candidates; ``score`` is the
    Euclidean distance of the original vectors in double precision, ties go to
    the smaller id. See ``vectors`` for what takes no part. A table with no
    usable vector gives no rows.
    """
    rows = written(vectors(df, id_col, vector_col), "rows")
    nodes = nodes_of(rows, k + 1)
    packed, graph = build_graph(nodes, neighbours, rounds=rounds)
    n = packed.count()
    links = with_reverse(graph, neighbours).unionAll(long_links(packed, n)).distinct()
    if n == 0:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = rows.filter(query_filter)
    asked = written(wanted.join(nodes.select("node", "v"), "v").select(F.col("id"), "node", "v"), "asked")
    # Queries with one vector walk once.
    walks = asked.select("node").distinct().join(packed, "node").select(F.col("node").alias("query"), "vec")
    # Some more than k, since the walk ranks by float32 distances.
    met = search(walks, packed, links, starts(walks, packed, n), 4 * k, max(beam, 4 * k))
    pairs = met.join(nodes, "node").select("query", "ids", F.col("v").alias("theirs"))
    pairs = pairs.join(asked.select(F.col("node").alias("query"), F.col("id").alias("query_id"), "v"), "query")
    gap = F.aggregate(F.zip_with("v", "theirs", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("query_id", F.explode("ids").alias("vec_id"), F.sqrt(gap).alias("score")).filter("vec_id != query_id")
    # A row id that repeats with several vectors counts once, at its nearest.
    scored = scored.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
