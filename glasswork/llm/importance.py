"""Quality by importance resampling.

Two generative models over hashed word n-grams, one of target text and one of
all raw text, give every document the log ratio of its likelihoods: its
importance. Adding Gumbel noise and taking the k largest keys samples k
documents without replacement in proportion to their importance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glasswork.llm.inputs import importable, texts, written
from glasswork.llm.labels import LABELLED_ROWS, labelled_sample
from glasswork.llm.pieces import PieceCache, mix, tool, word_hash
from glasswork.operators.ranks import row_positions

BUCKETS = 1 << 16
# Texts that a task holds as Python strings at once, and pieces whose buckets it remembers.
_SLICE = 512
_CACHED = 200_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_BIGRAM = np.uint64(0x9E3779B97F4A7C15)


class NgramBuckets:
    """Buckets of the words, marks and neighbouring pairs of a text; letter case counts."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = np.uint64(buckets)
        self.cache = PieceCache(lambda p: np.array([word_hash(t) for t in _TOKEN.findall(p)], "<u8").tobytes(), _CACHED)

    def __call__(self, text: str) -> np.ndarray:
        h = np.frombuffer(self.cache.join(text.split(" ")), "<u8")
        pairs = mix(h[:-1] * _BIGRAM + h[1:])
        return (np.concatenate([h, pairs]) % self.buckets).astype(np.int64)


def _ngrams(buckets: int) -> NgramBuckets:
    return tool(("n-grams", buckets), lambda: NgramBuckets(buckets))


@dataclass(frozen=True)
class ImportanceModel:
    """Log ratio of target to raw probability per bucket, and the share of labelled documents that are target."""

    log_ratio: np.ndarray
    target_share: float


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", buckets: int = BUCKETS,
        labelled_rows: int = LABELLED_ROWS, id_col: str = "doc_id", text_col: str = "text") -> ImportanceModel:
    """Count buckets over all documents (raw) and over the sampled documents with label 1 (target).

    Each task sums its own counts, so a bucket meets one row per task. Counts
    get one added, so no bucket is impossible. Without any target document the
    ratio is 0 everywhere.
    """
    sample = labelled_sample(labels, label_col, rows=labelled_rows)
    target = frozenset(i for i, y in sample.items() if y == 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams = _ngrams(buckets)
        raw, wanted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for i, text in zip(batch["_id"].to_pylist(), batch["_text"]):
                found = np.bincount(ngrams(text.as_py()), minlength=0)
                raw[: len(found)] += found
                if i in target:
                    wanted[: len(found)] += found
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(wanted[used])],
                                         names=["bucket", "raw", "target"])

    parts = texts(docs, id_col, text_col).mapInArrow(count, "bucket long, raw long, target long")
    rows = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, wanted = np.ones(buckets), np.ones(buckets)
    for r in rows:  # one row per bucket at most
        raw[r.bucket] += r.raw
        wanted[r.bucket] += r.target
    ratio = np.log(wanted / wanted.sum()) - np.log(raw / raw.sum()) if target else np.zeros(buckets)
    return ImportanceModel(ratio, len(target) / len(sample) if sample else 1.0)


def _scorer(model: ImportanceModel, seed: int):
    ratio, buckets = model.log_ratio, len(model.log_ratio)

    def score(ids: list, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ngrams = _ngrams(buckets)
        sizes, weight = np.zeros(len(found), np.int64), np.zeros(len(found))
        for k, text in enumerate(found):  # one text's buckets at a time
            spots = ngrams(text)
            sizes[k], weight[k] = len(spots), ratio[spots].sum()
        named = np.array([-1 if i is None else i for i in ids], np.int64).astype(np.uint64)
        unit = (mix(named + np.uint64(seed * int(_BIGRAM) % 2**64)) >> np.uint64(11)).astype(float) * 2.0**-53
        gumbel = -np.log(-np.log(np.clip(unit, 2.0**-53, 1 - 2.0**-53)))
        return sizes, weight, weight + gumbel

    return score


def score(docs: DataFrame, model: ImportanceModel, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_grams, log_weight, key); an empty or null text has weight 0, so its key is the noise alone."""
    scored = _scorer(model, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _SLICE):
                some = batch.slice(a, _SLICE)
                n, weight, key = scored(some["_id"].to_pylist(), some["_text"].to_pylist())
                yield pa.RecordBatch.from_arrays([some["_id"], pa.array(n), pa.array(weight), pa.array(key)],
                                                 names=["doc_id", "n_grams", "log_weight", "key"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_grams long, log_weight double, key double")


def resample(docs: DataFrame, model: ImportanceModel, k: int | None = None, seed: int = 7, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The ``k`` documents with the largest keys, as rows of ``score``; documents that tie with the last stay too.

    ``k`` defaults to the labelled share of target text times the number of
    documents. The k-th key is found by distributed ranks over the narrow
    scores; nothing is sorted in one task.
    """
    scored = written(score(docs, model, seed, id_col, text_col), "importance")
    n = scored.count()
    k = round(model.target_share * n) if k is None else k
    if k >= n:
        return scored
    if k <= 0:
        return scored.limit(0)
    placed = row_positions(scored.withColumn("_down", -F.col("key")), "_down", ["doc_id"])
    last = placed.filter(F.col("position") == k - 1).first()["key"]
    return scored.filter(F.col("key") >= last)


def keep_sampled(docs: DataFrame, model: ImportanceModel, k: int | None = None, seed: int = 7, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The documents themselves, all columns, for which ``resample`` decides to stay; texts are not shuffled."""
    importable(docs.sparkSession)
    least = resample(docs, model, k, seed, id_col, text_col).agg(F.min("key")).first()[0]
    if least is None:
        return docs.limit(0)
    scored, schema = _scorer(model, seed), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _SLICE):
                some = batch.slice(a, _SLICE)
                ids = some[id_col].cast(pa.int64()).to_pylist()
                _, _, key = scored(ids, ["" if t is None else t for t in some[text_col].to_pylist()])
                yield some.filter(pa.array(key >= least))

    return docs.mapInArrow(run, schema)
