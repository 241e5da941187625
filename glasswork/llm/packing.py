"""Mixture-controlled packing of token ids into fixed sequences.

Sources are queues. Every window takes from each source its share of the
window's tokens; what integer rounding leaves over is carried to the next
window as a deficit. In closed form the deficit round robin has taken
``floor(w * quantum)`` tokens of a source after ``w`` windows, so a document's
place follows from its place in its queue alone: no window waits for another,
and the deficit passes partition borders for free. When a queue runs dry the
others share its part in proportion: a new phase with larger quanta.

The windows follow each other as one stream that is cut into sequences, so all
are full. The rest after the last full one is cut into powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from glasswork.llm.inputs import importable, slices, written
from glasswork.llm.tokenizing import encoder
from glasswork.sources.checkpoint import cut_lineage

SEQUENCE = 2048
WINDOW_SEQUENCES = 64
_UNIT = 1 << 40  # quanta are whole numbers of this fraction of a token
# Rows (source, part) that are broadcast; beyond that Spark joins them.
BROADCAST_BASES = 100_000
_BATCH_DOCS = 2048
_PIECES = ("doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
           "offset long, window long")


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col="doc_id", text_col="text",
              source_col="source") -> DataFrame:
    """Rows (id, source, part, before, n, ids) in a written table; ``before`` counts the source's
    earlier tokens in the same part. A null text is empty, a null source a source of its own."""
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = b"" if end_id is None else encode.pack([end_id])
        part, taken = TaskContext.get().partitionId(), {}
        for batch in batches:
            for some in slices(batch, "text"):
                ids = encode.encode(some["text"], end).cast(pa.binary())
                n = pc.divide(pc.binary_length(ids), encode.width).cast(pa.int64())
                before = []
                for source, tokens in zip(some["source"].to_pylist(), n.to_pylist()):
                    before.append(taken.get(source, 0))
                    taken[source] = before[-1] + tokens
                yield pa.RecordBatch.from_arrays(
                    [some["id"], some["source"], pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), n, ids],
                    names=["id", "source", "part", "before", "n", "ids"])

    out = rows.mapInArrow(encode_rows, "id long, source string, part int, before long, n long, ids binary")
    return written(out, "packed-ids")


def phases(totals: dict[str, int], targets: dict[str, float] | None, window: int) -> list[dict]:
    """Stretches of windows with constant quanta, one more each time a queue runs dry.

    Each has the first window, per source the quantum (in ``_UNIT`` parts of a
    token) and the tokens taken before. Without ``targets`` the shares are those
    of the corpus, so all queues end together. A source without a target gets
    its share once the others are through.
    """
    left = {s: n for s, n in totals.items() if n > 0}
    taken = {s: 0 for s in left}
    weights = {s: Fraction(left[s] if targets is None else targets.get(s, 0)) for s in left}
    if any(w < 0 for w in weights.values()):
        raise ValueError("target proportions must not be negative")
    out, first = [], 0
    while left:
        active = {s: weights[s] for s in left if weights[s] > 0} or {s: Fraction(n) for s, n in left.items()}
        total = sum(active.values())
        quantum = {s: max(1, int(_UNIT * window * w / total)) for s, w in active.items()}
        windows = {s: -(-left[s] * _UNIT // quantum[s]) for s in active}
        # The last window of a phase ends with the first queue that runs dry in it.
        run = min(windows.values())
        out.append({"first": first, "run": run, "quantum": quantum, "taken": {s: taken[s] for s in active}})
        for s in active:
            got = min(left[s], quantum[s] * run // _UNIT)
            taken[s], left[s] = taken[s] + got, left[s] - got
        left = {s: n for s, n in left.items() if n}
        first += run
    return out


class Plan:
    """Where each token of each queue goes: pure arithmetic on the phases."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None, window: int = SEQUENCE * WINDOW_SEQUENCES,
                 sequence: int = SEQUENCE):
        self.totals, self.sequence = totals, sequence
        self.tokens = sum(totals.values())
        self.order = sorted(totals, key=lambda s: (s is not None, s))
        self.phases = phases(totals, targets, window)

    def taken(self, source, phase: dict, k: int) -> int:
        """Tokens of a source that the first ``k`` windows of a phase and all earlier phases took."""
        if source in phase["quantum"]:
            return min(self.totals[source], phase["taken"][source] + phase["quantum"][source] * k // _UNIT)
        return self.done_before(source, phase)

    def done_before(self, source, phase: dict) -> int:
        """Tokens of a source that sits out this phase, taken in earlier ones."""
        done = 0
        for p in self.phases:
            if p is phase:
                break
            if source in p["quantum"]:
                done = min(self.totals[source], p["taken"][source] + p["quantum"][source] * p["run"] // _UNIT)
        return done

    def spots(self, source, a: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """The tokens ``a .. a+n-1`` of a queue as (start in them, length, place in the stream, window)."""
        at, end = a, a + n
        for phase in self.phases:
            q = phase["quantum"].get(source)
            if q is None or at >= end:
                continue
            base, last = phase["taken"][source], self.taken(source, phase, phase["run"])
            while base <= at < min(end, last):
                # The window k whose range [taken(k), taken(k+1)) holds the token.
                k = ((at - base + 1) * _UNIT - 1) // q
                while k > 0 and self.taken(source, phase, k) > at:
                    k -= 1
                while self.taken(source, phase, k + 1) <= at:
                    k += 1
                low, high = self.taken(source, phase, k), self.taken(source, phase, k + 1)
                place = self._before(source, phase, k) + at - low
                size = min(end, high) - at
                yield at - a, size, place, phase["first"] + k
                at += size

    def _before(self, source, phase: dict, k: int) -> int:
        """Stream tokens before this source's turn in window ``k`` of a phase; a source's turn follows the order."""
        key = (id(phase), k)
        if getattr(self, "_key", None) != key:
            self._key, self._starts = key, {}
            place = sum(self.taken(s, phase, k) for s in self.order if self.totals[s])
            for s in self.order:
                self._starts[s] = place
                if s in phase["quantum"]:
                    place += self.taken(s, phase, k + 1) - self.taken(s, phase, k)
        return self._starts[source]

    def cut(self, place: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """A stretch of the stream as (start in it, length, sequence, offset).

        Sequences are full up to the last multiple of their length; the rest is
        cut by its binary digits, largest first, so nothing is padded.
        """
        full = self.tokens // self.sequence
        at = place
        while at < place + n:
            seq, off = divmod(at, self.sequence)
            room = self.sequence - off
            if seq >= full:
                rest, off = self.tokens - full * self.sequence, at - full * self.sequence
                seq = full
                for bit in range(self.sequence.bit_length() - 1, -1, -1):
                    if rest >> bit & 1:
                        if off < 1 << bit:
                            room = (1 << bit) - off
                            break
                        off -= 1 << bit
                        seq += 1
            size = min(room, place + n - at)
            yield at - place, size, seq, off
            at += size


def pack(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, targets: dict[str, float] | None = None,
         sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES, with_ids: bool = False, id_col="doc_id",
         text_col="text", source_col="source") -> DataFrame:
    """One row per piece of a document: its place in the document, its sequence and the offset there.

    Every id of every document lies in exactly one piece. ``targets`` gives the
    wanted share of tokens per source (default: the shares of the corpus).
    ``with_ids`` adds the piece's ids as little-endian unsigned 32-bit bytes.
    A null text is an empty one, repeated rows are packed each, a null source is
    a source, and an empty table gives no pieces. The driver sees one total per
    source; ids are encoded once, written, and read in place.
    """
    if sequence < 1:
        raise ValueError("a sequence holds at least one token")
    path = tokenizer_path
    rows = tokenized(docs, path, end_id, id_col, text_col, source_col)
    sums = rows.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    along = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = cut_lineage(sums.select(F.struct("source").alias("queue"), F.col("part").alias("file"), "tokens",
                                    F.coalesce(F.sum("tokens").over(along), F.lit(0)).alias("base")))
    # One total per source reaches the driver.
    totals = {r.source: r.tokens for r in bases.groupBy("queue.source").agg(F.sum("tokens").alias("tokens")).collect()}
    side = bases.select("queue", "file", "base")
    if side.count() <= BROADCAST_BASES:
        side = F.broadcast(side)
    rows = rows.join(side, (F.struct("source") == F.col("queue")) & (F.col("part") == F.col("file"))).select(
        "id", "source", (F.col("base") + F.col("before")).alias("spot"), "n", "ids")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(totals, targets, sequence * window_sequences, sequence)
        dtype = encoder(path).dtype
        for batch in batches:
            for a in range(0, batch.num_rows, _BATCH_DOCS):
                out = [[] for _ in range(10)]
                some = batch.slice(a, _BATCH_DOCS)
                for doc, source, spot, n, raw in zip(
                        *[some[c].to_pylist() for c in ("id", "source", "spot", "n", "ids")]):
                    ids = np.frombuffer(raw, dtype).astype("<u4")
                    for start, size, at, window in plan.spots(source, spot, n):
                        for inner, length, seq, offset in plan.cut(at, size):
                            cut = ids[start + inner: start + inner + length].tobytes()
                            for column, value in zip(out, (doc, source, start + inner, length, zlib.crc32(cut), n, seq, offset, window, cut)):
                                column.append(value)
                types = [pa.int64(), pa.string(), *[pa.int64()] * 7, pa.binary()]
                names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "ids"]
                keep = 10 if with_ids else 9
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:keep], types)], names=names[:keep])

    return rows.mapInArrow(place, _PIECES + (", ids binary" if with_ids else ""))
