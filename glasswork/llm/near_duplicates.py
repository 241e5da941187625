"""Near-duplicate documents by ProbMinHash.

Every distinct shingle of a text starts a Poisson process whose rate is its
weight (how often it occurs). Each arrival falls on a random register; a
register keeps the shingle of its earliest arrival. A process stops once its
time is past the latest register, so a text costs about one arrival per shingle
plus ``m log m``, however many registers there are. Two texts agree on a
register with the probability Jaccard of their weighted shingles.

Registers in bands give buckets. Inside a bucket texts whose registers agree too
rarely for the wanted similarity part ways; the others form families. Inside a
family the exact weighted similarity of all pairs verifies. Neither step lists
pairs: a task compares a bounded block of texts with another one and returns
links that connect the same texts, at most one per text and class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glasswork.llm.components import connected_components
from glasswork.llm.inputs import numbered, texts, written
from glasswork.llm.pieces import WordHasher, mix, shingles, tool, weighted

REGISTERS, BAND_ROWS = 96, 4  # a pair at 0.8 shares no band with probability (1 - 0.8**4) ** 24 = 3e-6
SIMILARITY = 0.8
# Registers that two texts must share to be compared exactly, in standard deviations below the expected number.
DEVIATIONS = 5.0
# Texts of a bucket or family that one task takes; larger ones go block by block against block.
BLOCK = 1024
BATCH_ROWS = 2_000
BROADCAST_KEYS = 200_000
_BATCH_SHINGLES = 1 << 15
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def signatures(profiles: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """A row of ``registers`` shingles per (distinct shingles, weights) profile; profiles must not be empty."""
    sizes = [len(p[0]) for p in profiles]
    shingle = np.concatenate([p[0] for p in profiles])
    rate = np.concatenate([p[1] for p in profiles]).astype(float)
    text = np.repeat(np.arange(len(profiles)), sizes)
    first = np.full(len(profiles) * registers, np.inf)  # earliest arrival per register
    winner = np.zeros(len(first), np.uint64)
    time, live, arrival = np.zeros(len(shingle)), np.arange(len(shingle)), 0
    while len(live):
        arrival += 1
        random = mix(shingle[live] + np.uint64(arrival * int(_C1) % 2**64))
        unit = ((random >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        time[live] -= np.log(unit) / rate[live]
        spot = text[live] * registers + (mix(random + _C2) % np.uint64(registers)).astype(np.int64)
        early = np.flatnonzero(time[live] < first[spot])
        early = early[np.argsort(-time[live[early]], kind="stable")]  # the earliest is written last
        first[spot[early]] = time[live[early]]
        winner[spot[early]] = shingle[live[early]]
        latest = first.reshape(-1, registers).max(1)
        live = live[time[live] < latest[text[live]]]
    return winner.reshape(-1, registers)


def bands(signature: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per band and text; keys of different bands differ."""
    parts = signature.reshape(len(signature), -1, rows)
    keys = np.broadcast_to(mix(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * _C3), parts.shape[:2]).copy()
    for r in range(rows):
        keys = mix(keys + parts[:, :, r])
    return keys


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    return weighted(shingles(tool(("words",), WordHasher)(text)))


def _banded(docs: DataFrame) -> DataFrame:
    """Rows (_id, md5, bands, sketch): the bands' keys and a byte per register, empty for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sketches, waiting, held = [b""] * batch.num_rows, [b""] * batch.num_rows, [], 0
            for k, text in enumerate(batch["_text"]):
                p = profile(text.as_py())
                if len(p[0]):
                    waiting.append((k, p))
                    held += len(p[0])
                if waiting and (held >= _BATCH_SHINGLES or k == batch.num_rows - 1):
                    found = signatures([p for _, p in waiting])
                    for (row, _), band, sketch in zip(waiting, bands(found), (mix(found) & np.uint64(255)).astype(np.uint8)):
                        keys[row], sketches[row] = band.astype("<i8").tobytes(), sketch.tobytes()
                    waiting, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], batch["md5"], pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())],
                names=["_id", "md5", "bands", "sketch"])

    return docs.mapInArrow(run, "_id long, md5 string, bands binary, sketch binary")


def _members(nodes: DataFrame) -> DataFrame:
    """Rows (bucket, node): the bands of each distinct text, without buckets of one."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(b.as_py(), "<i8") for b in batch["bands"]]
            node = np.repeat(batch["node"].to_numpy(), [len(k) for k in keys])
            bucket = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node)], names=["bucket", "node"])

    rows = written(nodes.select("node", "bands").mapInArrow(explode, "bucket long, node long"), "bands")
    shared = rows.groupBy("bucket").agg(F.count("node").alias("n")).filter("n > 1").select("bucket")
    return rows.join(_bounded(shared), "bucket")


def _bounded(keys: DataFrame) -> DataFrame:
    """Broadcast where a count proves the keys few; left to a shuffle join otherwise."""
    keys = written(keys, "keys")
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _profiles(docs: DataFrame, nodes: DataFrame, involved: DataFrame) -> DataFrame:
    """Rows (node, data): distinct shingles and weights of the texts that have a family."""
    wanted = _bounded(nodes.join(involved, "node").select("node", "md5", F.col("first_id").alias("_first")))
    rows = docs.join(wanted, "md5").filter(F.col("_id").eqNullSafe(F.col("_first"))).select("node", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profile(t.as_py()) for t in batch["_text"]]
            data = [p[0].astype("<u8").tobytes() + p[1].astype("<i4").tobytes() for p in found]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(data, pa.binary())], names=["node", "data"])

    return rows.mapInArrow(run, "node long, data binary").dropDuplicates(["node"])


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<i4", n, 8 * n)


def _blocked(members: DataFrame, group: str, payload: DataFrame) -> DataFrame:
    """Rows (batch, meeting, node, data): each pair of blocks of a group meets once, with the payload of its nodes.

    A group of up to ``BLOCK`` nodes is one block. Groups of one node are left
    out. A batch holds whole meetings, some thousand rows in all.
    """
    sizes = members.groupBy(group).agg(F.count("node").alias("n")).filter("n > 1").select(
        group, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meeting = F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other"))
    placed = dealt.select(group, "node", "block", other.alias("other")).select(meeting.alias("meeting"), "node")
    batches = max(1, members.count() // BATCH_ROWS)
    return placed.withColumn("batch", F.pmod("meeting", F.lit(batches))).join(payload, "node")


def _meetings(table: pa.Table) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Nodes and payloads of each meeting of a batch."""
    meeting = table["meeting"].to_numpy()
    order = np.argsort(meeting, kind="stable")
    node, data = table["node"].to_numpy()[order], table["data"].to_pylist()
    cuts = np.flatnonzero(np.diff(meeting[order])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(order)]):
        yield node[a:b], [data[i] for i in order[a:b]]


def _spanning(node: np.ndarray, alike: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the same nodes as a symmetric relation does: from the smallest node of each class to the others.

    Buckets that hold the same texts then mostly give the same links.
    """
    order = np.argsort(node)
    node, alike = node[order], alike[np.ix_(order, order)]
    label = np.arange(len(node))
    for i in np.flatnonzero(alike.any(1)):
        near = np.unique(label[np.flatnonzero(alike[i] & (label != label[i]))])
        if len(near):
            least = min(label[i], near[0])
            label[np.isin(label, [label[i], *near])] = least
    joined = np.flatnonzero(label != np.arange(len(node)))
    return list(zip(node[label[joined]].tolist(), node[joined].tolist()))


def _linked(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _families(members: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Links between texts of a bucket whose registers agree often enough to be similar."""
    least = REGISTERS * similarity - DEVIATIONS * (REGISTERS * similarity * (1 - similarity)) ** 0.5

    def compare(table: pa.Table) -> pa.Table:
        links = []
        for node, data in _meetings(table):
            sketch = np.frombuffer(b"".join(data), np.uint8).reshape(len(node), -1)
            links += _spanning(node, np.stack([np.count_nonzero(sketch == s, axis=1) >= least for s in sketch]))
        return _linked(links)

    rows = _blocked(members, "bucket", nodes.select("node", F.col("sketch").alias("data")))
    return rows.groupBy("batch").applyInArrow(compare, "a long, b long")


def intersections(profiles: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum of the smaller weights for every pair of profiles.

    A weight w counts as w features (shingle, 1) .. (shingle, w), so the sum is
    a number of common features. Features of few profiles add to their pairs one
    by one, the others by matrix products over slices of the features.
    """
    n = len(profiles)
    sizes = [int(p[1].sum()) for p in profiles]
    level = np.concatenate([np.arange(sum(p[1])) - np.repeat(np.cumsum(p[1]) - p[1], p[1]) for p in profiles]).astype(np.uint64)
    feature = mix(np.concatenate([np.repeat(p[0], p[1]) for p in profiles]) + level * _C3)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(feature, kind="stable")
    feature, owner = feature[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]]))
    held = np.diff(np.append(first, len(feature)))
    common = np.zeros((n, n), np.float32)
    for size in range(2, 9):
        group = owner[first[held == size][:, None] + np.arange(size)]
        for i in range(size):
            for j in range(i + 1, size):
                common += np.bincount(group[:, i] * n + group[:, j], minlength=n * n).reshape(n, n)
    common += common.T
    wide = np.flatnonzero(held > 8)
    for a in range(0, len(wide), 2048):
        slice_ = wide[a: a + 2048]
        spots = np.repeat(first[slice_] - np.cumsum(held[slice_]) + held[slice_], held[slice_]) + np.arange(held[slice_].sum())
        table = np.zeros((n, len(slice_)), np.float32)
        table[owner[spots], np.repeat(np.arange(len(slice_)), held[slice_])] = 1
        common += table @ table.T
    return common


def _verified(families: DataFrame, profiles: DataFrame, similarity: float) -> DataFrame:
    """Links between texts of a family whose exact weighted similarity is large enough."""

    def compare(table: pa.Table) -> pa.Table:
        links = []
        for node, data in _meetings(table):
            found = [_read(d) for d in data]
            common = intersections(found).astype(float)
            total = np.array([p[1].sum() for p in found], float)
            links += _spanning(node, common >= similarity * (total[:, None] + total[None] - common) - 1e-9)
        return _linked(links)

    rows = _blocked(families, "label", profiles)
    return rows.groupBy("batch").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, class_id, copies), one per input row: ``class_id`` is the smallest id of the row's class.

    Texts are in one class when a chain of pairs joins them whose weighted
    similarity of five-word shingles is at least ``similarity``; equal texts
    always are, ``copies`` counts them. Words are lower-case runs of letters and
    digits. A shorter text is one shingle; a text without words (null is '')
    has only its exact copies. Repeated rows are copies. A class without any id
    has a null ``class_id``.
    """
    rows = texts(docs, id_col, text_col).withColumn("md5", F.md5(F.col("_text")))
    banded = written(_banded(rows), "signatures")
    nodes = banded.groupBy("md5").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("copies"),
                                      F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    families = connected_components(_families(_members(nodes), nodes, similarity))
    profiles = _profiles(rows, nodes, families.select("node"))
    links = _verified(families, profiles, similarity)
    classes = connected_components(links).withColumnRenamed("node", "_node")
    named = nodes.select("node", "md5", "first_id", "copies")
    labelled = named.join(classes, F.col("node") == F.col("_node"), "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("first_id").alias("class_id"))
    named = labelled.join(least, "label")
    return banded.select("_id", "md5").join(named.select("md5", "class_id", "copies"), "md5").select(
        F.col("_id").alias("doc_id"), "class_id", "copies")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with one row per class: that of the smallest number (see ``numbered``).

    The numbers to drop are broadcast where a count proves them few, and joined
    otherwise.
    """
    rows = numbered(docs, id_col)
    found = near_duplicates(rows.select("_row", F.col("_doc").getField(text_col).alias("text")), similarity, "_row")
    extra = _bounded(found.filter("doc_id != class_id").select(F.col("doc_id").alias("_row")))
    return rows.join(extra, "_row", "left_anti").select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
