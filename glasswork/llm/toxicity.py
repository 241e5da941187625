"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over hashed
word features; a document is toxic when any sentence is, so its score is the
noisy-or ``1 - prod(1 - s)``. Only documents are labelled: the loss of the bag
tells the gradient which sentences to blame, and the same weights then point at
the offending sentences. Sentences without any feature that has a weight tell
nothing about a document; together they count as one sentence, and only where
there is no other, in training as in scoring, so length by itself makes no
document toxic.

Training keeps a bounded, documented sample of labelled documents. Features that
toxic documents do not hold clearly more often than chance are left out; the
others start from their log odds. Then the parts of the sample run mini-batches
of their own from the common weights, and the mean of their weights is the next
common set.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glasswork.llm.inputs import texts, written
from glasswork.llm.labels import LABELLED_ROWS, labelled_sample
from glasswork.llm.pieces import PieceCache, tool, word_hash

BUCKETS = 1 << 18
ROUNDS = 6
# A feature takes part when it is in this many standard deviations more toxic documents than chance gives.
DEVIATIONS = 5.0
LEAST_DOCS = 3
LOCAL_EPOCHS = 2
PARTS = 8
_BATCH_DOCS = 32
_END = 0xFFFFFFFF
_STOP = re.compile(r"[.!?\n]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_WORD = re.compile(r"[^\W\d_]+")


class SentenceFeatures:
    """Feature buckets of a text's sentences: each word, its start and its end."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.cache = PieceCache(self._make)

    def _make(self, piece: str) -> bytes:
        out, chunks = [], _STOP.split(piece)
        for k, chunk in enumerate(chunks):
            for word in _WORD.findall(chunk.lower()):
                named = [f"w{word}"]
                if len(word) > 5:
                    named += [f"<{word[:5]}", f">{word[-5:]}"]
                out += [word_hash(n) % self.buckets for n in named]
            if k < len(chunks) - 1:
                out.append(_END)
        return np.array(out, "<u4").tobytes()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Features in order, and where each sentence that has any starts; an empty text is one empty sentence."""
        raw = np.frombuffer(self.cache.join(text.split(" ")), "<u4")
        ends = raw == _END
        number = np.cumsum(ends)[~ends]
        features = raw[~ends].astype(np.int64)
        starts = np.flatnonzero(np.diff(number, prepend=-1)) if len(features) else np.zeros(0, np.int64)
        return features, starts


def _features(buckets: int) -> SentenceFeatures:
    return tool(("sentences", buckets), lambda: SentenceFeatures(buckets))


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sentence_logits(weights: np.ndarray, bias: float, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One per sentence; a text without features is one sentence with the bias alone."""
    if len(features) == 0:
        return np.array([bias])
    return bias + np.add.reduceat(weights[features], starts)


def bag_score(sentences: np.ndarray) -> float:
    """Noisy-or of sentence logits: one minus the chance that none is toxic."""
    return float(-np.expm1(-np.logaddexp(0, sentences).sum()))


def _document_score(weights: np.ndarray, bias: float, features: np.ndarray, starts: np.ndarray, logits: np.ndarray) -> float:
    """The noisy-or over the bag that training sees: the sentences with a weight, or one with the bias alone."""
    told = np.logical_or.reduceat(weights[features] != 0, starts) if len(features) else np.zeros(1, bool)
    return bag_score(logits[told] if told.any() else np.array([bias]))


def _train_part(bags: list[tuple[np.ndarray, np.ndarray, int]], weights: np.ndarray, bias: float, epochs: int, seed: int,
                rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Mini-batch steps with per-weight step sizes (Adagrad) over the bags of one part."""
    weights, memory, bias_memory = weights.copy(), np.full(len(weights), 1e-3), 1e-3
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        shuffled = order.permutation(len(bags))
        for a in range(0, len(shuffled), _BATCH_DOCS):
            chosen = [bags[i] for i in shuffled[a: a + _BATCH_DOCS]]
            features = np.concatenate([b[0] for b in chosen])
            sizes = np.concatenate([np.diff(np.append(b[1], len(b[0]))) if len(b[0]) else [0] for b in chosen]).astype(np.int64)
            owner = np.repeat(np.arange(len(chosen)), [max(1, len(b[1])) for b in chosen])
            label = np.array([b[2] for b in chosen])
            sentence = np.repeat(np.arange(len(sizes)), sizes)
            logits = bias + np.bincount(sentence, weights[features], len(sizes))
            s = _sigmoid(logits)
            none = np.bincount(owner, -np.logaddexp(0, logits), len(chosen))  # log of the chance of no toxic sentence
            p = np.clip(-np.expm1(none), 1e-9, 1)
            pull = np.where(label == 1, np.exp(none) / p, -1.0)
            step = s * pull[owner] / len(chosen)
            g = np.bincount(features, step[sentence], len(weights))
            used = np.flatnonzero(g)
            grad = g[used] - decay * weights[used]
            memory[used] += grad**2
            weights[used] += rate * grad / np.sqrt(memory[used])
            bias_memory += step.sum() ** 2
            bias += rate * step.sum() / np.sqrt(bias_memory)
    return weights, float(bias)


def _bags(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, int]]:
    return [(np.frombuffer(f, "<i4").astype(np.int64), np.frombuffer(s, "<i4").astype(np.int64), y)
            for f, s, y in zip(*[table[c].to_pylist() for c in ("features", "starts", "label")])]


def _only(bag: tuple[np.ndarray, np.ndarray, int], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The bag with the kept features; a sentence without any is dropped."""
    features, starts, label = bag
    stay = kept[features]
    sentence = np.searchsorted(starts, np.flatnonzero(stay), side="right")
    return features[stay], np.flatnonzero(np.diff(sentence, prepend=0)), label


def _counter(buckets: int):
    """Documents of one part per feature: all, and toxic ones."""

    def count(table: pa.Table) -> pa.Table:
        all_docs, toxic = np.zeros(buckets, "<i4"), np.zeros(buckets, "<i4")
        for features, _, label in _bags(table):
            found = np.unique(features)
            all_docs[found] += 1
            toxic[found] += label
        return pa.table({"all": pa.array([all_docs.tobytes()], pa.binary()), "toxic": pa.array([toxic.tobytes()], pa.binary())})

    return count


def _start(all_docs: np.ndarray, toxic: np.ndarray, n: int, positive: int) -> tuple[np.ndarray, np.ndarray]:
    """Which features take part, and the log odds they start from."""
    share = positive / n
    expected = all_docs * share
    clear = toxic - expected > DEVIATIONS * np.sqrt(expected * (1 - share))
    kept = clear & (toxic >= LEAST_DOCS)
    odds = np.log((toxic + 0.5) / (positive + 1)) - np.log((all_docs - toxic + 0.5) / (n - positive + 1))
    return kept, np.where(kept, odds, 0).astype(np.float32)


def _trainer(shared, seed: int):
    """One part's steps from the broadcast weights; the seed orders its documents."""

    def train(table: pa.Table) -> pa.Table:
        weights, bias, kept = shared.value
        bags = [_only(b, kept) for b in _bags(table)]
        weights, bias = _train_part(bags, weights, bias, LOCAL_EPOCHS, seed)
        return pa.table({"rows": [len(bags)], "bias": [bias], "weights": pa.array([weights.astype("<f4").tobytes()], pa.binary())})

    return train


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", where: Column | None = None, buckets: int = BUCKETS,
        labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS, parts: int = PARTS, id_col: str = "doc_id",
        text_col: str = "text") -> ToxicityModel:
    """Learn from at most ``labelled_rows`` labelled documents; ``where`` restricts their ids (column ``_id``).

    The sampled documents are written once as features. Each round every part
    sends one vector of ``buckets`` weights to the driver: parts and buckets are
    fixed, whatever the corpus. Without documents of both labels no feature has
    a weight and all scores are alike.
    """
    sample = labelled_sample(labels, label_col, id_col, labelled_rows, where)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _features(buckets)
        for batch in batches:
            rows = [(i, *find(t.as_py()), sample[i]) for i, t in zip(batch["_id"].to_pylist(), batch["_text"]) if i in sample]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].astype("<i4").tobytes() for r in rows], pa.binary()),
                 pa.array([r[2].astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int64())],
                names=["id", "features", "starts", "label"])

    bags = texts(docs, id_col, text_col).mapInArrow(featurize, "id long, features binary, starts binary, label long")
    bags = written(bags.repartition(parts, F.xxhash64("id", "features")).sortWithinPartitions("id", "features"), "bags")
    spark = docs.sparkSession
    grouped = bags.withColumn("part", F.pmod(F.xxhash64("id", "features"), F.lit(parts)).cast("long")).groupBy("part")
    seen = bags.agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("positive")).first()
    weights, bias = np.zeros(buckets, np.float32), float(np.log(max(seen.positive, 0.5) / max(seen.n, 1) / 30))
    if not 0 < seen.positive < seen.n:
        return ToxicityModel(weights, bias)
    counted = grouped.applyInArrow(_counter(buckets), "all binary, toxic binary").collect()
    sums = [sum(np.frombuffer(r[c], "<i4").astype(float) for r in counted) for c in ("all", "toxic")]
    kept, weights = _start(*sums, seen.n, seen.positive)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((weights, bias, kept))

        got = grouped.applyInArrow(_trainer(shared, k), "rows long, bias double, weights binary").collect()
        total = sum(r.rows for r in got)
        weights = sum(np.frombuffer(r.weights, "<f4") * (r.rows / total) for r in got).astype(np.float32)
        bias = sum(r.bias * r.rows for r in got) / total
        shared.unpersist()
    return ToxicityModel(weights, bias)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score, predicted, n_sentences, worst): ``worst`` is the number (from 0) of the sentence with the
    largest score. Null and empty texts get the score of one empty sentence."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        find = _features(len(weights))
        for batch in batches:
            bags = [find(t.as_py()) for t in batch["_text"]]
            logits = [_sentence_logits(weights, bias, *b) for b in bags]
            p = np.array([_document_score(weights, bias, *b, z) for b, z in zip(bags, logits)], float)
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array(p), pa.array((p >= threshold).astype(np.int32)),
                 pa.array([len(z) for z in logits], pa.int64()), pa.array([int(z.argmax()) for z in logits], pa.int64())],
                names=["doc_id", "score", "predicted", "n_sentences", "worst"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int, n_sentences long, worst long")


def offending_sentences(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, end, score, sentence): every sentence that scores at least ``threshold``, by code points."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        find = _features(len(weights))
        for batch in batches:
            rows = []
            for i, text in zip(batch["_id"].to_pylist(), batch["_text"]):
                for m in _SENTENCE.finditer(text.as_py()):
                    p = float(_sigmoid(_sentence_logits(weights, bias, *find(m[0]))).max())
                    if p >= threshold:
                        rows.append({"doc_id": i, "start": m.start(), "end": m.end(), "score": p, "sentence": m[0]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema(
                [("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("sentence", pa.string())]))

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, end long, score double, sentence string")
