"""Ranked lexical search by scanning the documents: no index of documents is made.

The distinct terms of all items, each between two separators, form one
Aho-Corasick automaton that goes to the documents. A document's other
characters are turned into separators, so the guards let whole terms match
only, and term frequencies are counted straight from the text. One scan counts
the documents of each term, a second one weighs the matches: a term's outputs
lead to the items that hold it. A task keeps the best ``k`` documents of each
item, so what is shuffled depends on the items and not on the documents.

All arithmetic is in 64-bit integers but for one logarithm per term.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from glasswork.llm.inputs import texts
from glasswork.llm.pieces import tool

# A term is a run of characters other than ASCII ones that are no letter and no digit.
_BETWEEN = bytes(b for b in range(128) if not chr(b).isalnum())
_FOLD = bytes.maketrans(_BETWEEN + ascii_uppercase.encode(), b" " * len(_BETWEEN) + ascii_lowercase.encode())
_TERM = re.compile(rb"[^ ]+")
# What is broadcast at once: items are searched in blocks of so many characters.
BLOCK_CHARS = 4_000_000
_SLICE_BYTES, _CELLS = 4_000_000, 4_000_000
_ROUNDS = 16
_DOCS, _TERMS = -1, -2


def terms_of(text: str) -> list[bytes]:
    return _TERM.findall(text.encode().translate(_FOLD))


class TermScanner:
    """Counts the listed terms in folded text."""

    def __init__(self, terms: list[bytes]):
        import ahocorasick

        self.size = len(terms)
        self.automaton = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            self.automaton.add_word(f" {term.decode('latin-1')} ", number)
        if terms:
            self.automaton.make_automaton()

    def slices(self, column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """Consecutive folded texts of about ``_SLICE_BYTES`` with the number of the first; a longer one is a slice."""
        most = max(1, _CELLS // max(1, self.size))
        first, some, size = 0, [], 0
        for i, value in enumerate(column):
            some.append(value.as_py().encode().translate(_FOLD))
            size += len(some[-1])
            if size >= _SLICE_BYTES or len(some) >= most:
                yield first, some
                first, some, size = i + 1, [], 0
        if some:
            yield first, some

    def __call__(self, folded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All terms of each text; (text, term, times) of the listed ones, in order."""
        sizes = np.array([len(t) + 1 for t in folded], "i8")
        joined = b" ".join([b"", *folded, b""])
        gap = np.frombuffer(joined, "u1") == 32
        begins = np.flatnonzero(gap[:-1] & ~gap[1:])  # the separator before each term
        borders = np.cumsum(sizes)
        lengths = np.diff(np.searchsorted(begins, np.concatenate([[0], borders])))
        keys, times = np.zeros(0, "i8"), np.zeros(0, "i8")
        at = 0
        while self.size and at + 1 < len(joined):
            stop = joined.find(b" ", min(at + _SLICE_BYTES, len(joined) - 1))
            found = np.fromiter(chain.from_iterable(self.automaton.iter(joined[at: stop + 1].decode("latin-1"))), "i8")
            found = found.reshape(-1, 2)
            # A match ends with the separator behind it, which may be the last one of its text.
            text = np.searchsorted(borders, found[:, 0] + at, "left")
            more, n = np.unique(text * self.size + found[:, 1], return_counts=True)
            keys, which = np.unique(np.concatenate([keys, more]), return_inverse=True)
            times = np.bincount(which, np.concatenate([times, n]), len(keys)).astype("i8")
            at = stop
        return lengths, keys // max(1, self.size), keys % max(1, self.size), times


def _scanner(name: str, terms: list[bytes]) -> TermScanner:
    """One automaton per Python worker and block of items."""
    return tool(("terms", name), lambda: TermScanner(terms))


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """All items, in blocks whose characters bound what is collected and broadcast; a block holds whole items."""
    rows = items.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.length("t") + 16), F.lit(0))).first()[0]
    count = -(-total // BLOCK_CHARS)
    for b in range(count):
        yield [(r.i, r.t) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == b).collect()]


def _corpus_counts(rows: DataFrame, shared, name: str) -> dict[int, int]:
    """Documents per listed term, documents with a term (``_DOCS``) and terms in all (``_TERMS``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(name, shared.value)
        df, docs, total = np.zeros(scan.size, "i8"), 0, 0
        for batch in batches:
            for _, some in scan.slices(batch["_text"]):
                lengths, _, term, _ = scan(some)
                df += np.bincount(term, minlength=scan.size)
                docs, total = docs + int((lengths > 0).sum()), total + int(lengths.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*seen.tolist(), _DOCS, _TERMS], pa.int64()), pa.array([*df[seen].tolist(), docs, total], pa.int64())],
            names=["term", "n"])

    found = rows.select("_text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in found.collect()}  # one row per term of the block


class _Best:
    """The best ``k`` documents of each item so far: score descending, then id ascending, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, "i8")
        self.rows = [(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, bool)) for _ in range(items)]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        new = np.flatnonzero(scores >= self.least[item])
        if len(new):
            both = [np.concatenate(c) for c in zip(self.rows[item], (scores[new], ids[new], null[new]))]
            order = np.lexsort((both[1], both[2], -both[0]))[:self.k]
            self.rows[item] = tuple(c[order] for c in both)
            if len(order) == self.k:
                self.least[item] = self.rows[item][0][-1]


def _scored(rows: DataFrame, shared, name: str, counts: dict[int, int], wanted: list[tuple[np.ndarray, np.ndarray]], terms: int,
            k: int) -> DataFrame:
    """Rows (item, doc_id, score): each task's best documents of each item of the block."""
    docs, total = counts.get(_DOCS, 0), counts.get(_TERMS, 0)
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * counts.get(t, 0) + 1))) for t in range(terms)], "i8")
    plan = rows.sparkSession.sparkContext.broadcast((weight, wanted))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, (weight, wanted) = _scanner(name, shared.value), plan.value
        kept = _Best(len(wanted), k)
        for batch in batches:
            null = np.array(batch["_id"].is_null())
            ids = batch["_id"].fill_null(0).to_numpy()
            for first, some in scan.slices(batch["_text"]):
                lengths, text, term, tf = scan(some)
                if not len(tf):
                    continue
                exact = 75 * int(lengths.max()) * docs < 1 << 63
                share = 75 * lengths * docs // total if exact else np.array([75 * int(n) * docs // total for n in lengths], "i8")
                m = 25 + share
                part = np.zeros((scan.size, len(some)), "i8")
                part[term, text] = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[text]))
                at = slice(first, first + len(some))
                for item, (own, repeats) in enumerate(wanted):
                    kept.add(item, repeats @ part[own], ids[at], null[at])
        for item, (score, ids, null) in enumerate(kept.rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(score), item, "i8")), pa.array(ids, mask=null), pa.array(score)], names=["item", "doc_id", "score"])

    return rows.mapInArrow(best, "item long, doc_id long, score long")


def _top(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each item with their rank; parts of an item first, so no task holds all its rows."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = scored.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(_ROUNDS)))
    parts = parts.withColumn("_rank", F.row_number().over(W.partitionBy("item", "_part").orderBy(*order))).filter(F.col("_rank") <= k)
    return parts.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` documents of each item with the highest score above 0.

    A term weighs ``floor(1000 ln((2 N + 2) / (2 df + 1)))``; a document with ``n`` terms has
    ``m = 25 + 75 n N div L``; the score sums ``weight * ((10^9 tf) div (1000 tf + 8 m))`` over the item's
    terms with repeats. Equal scores go by ascending document id, null ids last.

    Null and empty texts hold no term and are found by no item; an item without
    terms, or an empty table, gives no rows. Repeated rows of documents count and
    are found each; every row of ``items`` is an item, so a repeated one
    repeats its rows. Other columns are not read. Documents are scanned whole,
    twice per block of items, and never shuffled.
    """
    rows, out = texts(docs, id_col, text_col), None
    spark = docs.sparkSession
    for block in _blocks(items, item_col, item_text_col):
        words = [Counter(terms_of(t)) for _, t in block]
        terms = sorted(set(chain.from_iterable(words)))
        number = {t: i for i, t in enumerate(terms)}
        wanted = [(np.array([number[t] for t in w], "i8"), np.array([*w.values()], "i8")) for w in words]
        shared, name = spark.sparkContext.broadcast(terms), uuid.uuid4().hex
        counts = _corpus_counts(rows, shared, name)
        scored = _scored(rows, shared, name, counts, wanted, len(terms), k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item long, item_id long")
        part = _top(scored, k).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
