"""A hashed maximum-entropy language model with a class-factored softmax.

A word's probability is that of its class given the words before, times that of
the word inside its class. The class softmax is a log-linear model over hashed
features of the context: the last word, the last two classes, and the last class
with the one three back (a skip feature). Inside a class
the only feature is the word itself, whose maximum-entropy weight has a closed
form: its count plus one, with one place for unseen words.

Training deals all training documents out to rounds and trainers. A trainer
takes gradient steps from the common weights over its documents in batches, and
the mean of the changes, weighted by tokens, is the next common set. Counts of
all words are a distributed table; only its most frequent words are broadcast,
the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from glasswork.llm.inputs import slices, texts, written
from glasswork.llm.pieces import PieceCache, mix, tool

CLASS_BITS = 6
CLASSES = 1 << CLASS_BITS
BUCKETS = 1 << 13
ROUNDS = 3
# Most frequent words whose counts every task holds; their number is bounded by this.
HEAD_WORDS = 1 << 17
END, START = 0, 1  # ids of the end of a text, and of what stands before its first word; each a class of its own
_BATCH = 4096
_SAFE = 60.0  # exponentials up to here stay in range, summed and in single precision
_CHUNK = 256  # weight rows per message row
_RUN = 32  # lines of a run that are summed together with those of other runs


# Bytes with A-Z in lower case, and one in place of all white space.
_GAP = 32
_LOWER = np.frombuffer(bytes(range(256)).lower().translate(bytes.maketrans(bytes(range(9, 14)), bytes([_GAP]) * 5)), "u1")


class WordIds:
    """64-bit ids of a text's words and its end: 58 bits of hash above 6 bits of class.

    A-Z become lower case; words are split at spaces and the characters 9 to 13.
    A word's class comes from its first two characters.
    """

    def __init__(self):
        self.cache = PieceCache(self._make)

    @staticmethod
    def _make(word: bytes) -> bytes:
        first = word.decode("utf-8", "replace")[:2]
        kind = 2 + xxhash.xxh64_intdigest(first.encode()) % (CLASSES - 2)
        return (xxhash.xxh64_intdigest(word) >> CLASS_BITS << CLASS_BITS | kind).to_bytes(8, "little")

    def __call__(self, text: str) -> np.ndarray:
        return self.of_slice(pa.array([text], pa.string()))[0]

    def of_slice(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of each text; words are cut by numpy, and each distinct one is hashed once."""
        bounds = np.frombuffer(texts.buffers()[1], "i4")[texts.offset: texts.offset + len(texts) + 1]
        data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", "u1")[bounds[0]: bounds[-1]]]
        bounds = bounds - bounds[0]
        inside = data != _GAP
        first = np.zeros(len(data) + 1, bool)
        first[bounds[:-1]] = True
        first[1:-1] |= ~inside[:-1]
        first = first[:-1] & inside
        ends = np.searchsorted(np.flatnonzero(first), bounds[1:])  # words before the end of each text
        starts = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)).astype("i4")
        found = pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [
            None, pa.py_buffer(starts), pa.py_buffer(data[inside])]).dictionary_encode()
        # All distinct words become one value and are split again, which makes their objects quickly.
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(found.dictionary)], found.dictionary), b" ")[0].as_py().split()
        ids = np.frombuffer(self.cache.join(names), "<u8")[found.indices.to_numpy()]
        return np.split(np.insert(ids, ends, END), (ends + np.arange(1, len(ends) + 1))[:-1])

    def of(self, rows: pa.RecordBatch) -> Iterator[np.ndarray]:
        """The ids of each row's ``_text``."""
        for some in slices(rows, "_text"):
            yield from self.of_slice(some["_text"])


def _words() -> WordIds:
    return tool(("word ids",), WordIds)


def contexts(ids: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows (one per token) and classes of the tokens of several texts."""
    before = np.full(3, START, np.uint64)
    padded = np.concatenate([np.concatenate([before, x]) for x in ids])
    own = np.concatenate([np.concatenate([np.zeros(3, bool), np.ones(len(x), bool)]) for x in ids])
    at = np.flatnonzero(own)
    one = padded[at - 1]
    low = np.uint64(CLASSES - 1)
    c1, c2, c3 = one & low, padded[at - 2] & low, padded[at - 3] & low
    shift = np.uint64(CLASS_BITS)
    values = (one, (c1 << shift) | c2, (c1 << shift) | c3)
    n = np.uint64(buckets)
    rows = np.stack([(mix(v + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) % n).astype(np.int64) for k, v in enumerate(values)], 1)
    return rows, (padded[at] & low).astype(np.int64)


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the used rows, shifted where needed so that no exponential overflows."""
    logits = np.take(weights, rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        logits += np.take(weights, rows[:, k], axis=0)
    logits += bias
    if max(logits.max(), -logits.min()) > _SAFE:
        logits -= logits.max(1, keepdims=True)
    return logits


def class_log_probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log softmax over the classes, one line per token."""
    logits = _logits(weights, bias, rows)
    return logits - np.log(np.exp(logits).sum(1))[:, None]


def own_log_probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Log probability of each token's own class."""
    logits = _logits(weights, bias, rows)
    own = logits[np.arange(len(classes)), classes]
    np.exp(logits, out=logits)
    return own - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def _run_sums(values: np.ndarray, order: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``values[order]`` over runs, longest first: runs of up to ``_RUN`` by their k-th lines, the rest of longer ones by themselves."""
    out = np.take(values, order[first], axis=0)
    for k in range(1, min(_RUN, int(sizes[0]))):
        n = int(np.searchsorted(-sizes, -k, "left"))
        out[:n] += np.take(values, order[first[:n] + k], axis=0)
    for i in range(int(np.searchsorted(-sizes, -_RUN, "left"))):
        out[i] += np.take(values, order[first[i] + _RUN: first[i] + sizes[i]], axis=0).sum(0)
    return out


def gradient_step(weights: np.ndarray, bias: np.ndarray, memory: np.ndarray, rows: np.ndarray, classes: np.ndarray, rate: float) -> None:
    """One batch: the gradient of the log likelihood per used row, scaled by the row's past."""
    push = _logits(weights, bias, rows)
    np.exp(push, out=push)
    push *= (-1 / (push @ np.ones(push.shape[1], push.dtype)))[:, None]
    push[np.arange(len(classes)), classes] += 1
    flat = rows.astype(np.uint16).ravel() if len(weights) <= 1 << 16 else rows.ravel()  # short integers sort by radix
    order = np.argsort(flat, kind="stable")
    sorted_rows = flat[order].astype(np.int64)
    first = np.flatnonzero(np.diff(sorted_rows, prepend=-1))
    sizes = np.diff(first, append=len(order))
    longest = np.argsort(-sizes, kind="stable")
    used = sorted_rows[first[longest]]
    grad = _run_sums(push, order // rows.shape[1], first[longest], sizes[longest])
    memory[used] += np.einsum("ij,ij->i", grad, grad) / CLASSES
    grad *= (rate / np.sqrt(memory[used]))[:, None]
    weights[used] = np.take(weights, used, axis=0) + grad
    bias += rate * push.mean(0)


@dataclass(frozen=True)
class LanguageModel:
    weights: np.ndarray  # buckets x classes
    bias: np.ndarray
    class_tokens: np.ndarray  # training tokens per class
    class_words: np.ndarray  # distinct training words per class
    head: tuple[np.ndarray, np.ndarray]  # ids in order and counts of the most frequent words
    counts: DataFrame  # rows (word, tokens): every training word

    @property
    def tokens(self) -> int:
        return int(self.class_tokens.sum())

    @property
    def words(self) -> int:
        return int(self.class_words.sum())


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (word, tokens) of rows (_id, _text); each batch sends one row per distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words()
        for batch in batches:
            found, n = np.unique(np.concatenate([*words.of(batch)] or [np.zeros(0, "<u8")]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype("<u8").view("<i8")), pa.array(n.astype("<i8"))], names=["word", "tokens"])

    parts = docs.select("_text").mapInArrow(run, "word long, tokens long")
    return written(parts.groupBy("word").agg(F.sum("tokens").alias("tokens")), "word-counts")


def _head(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The words whose count reaches the smallest step of a sixteenth octave that at most ``limit`` words reach."""
    step = F.floor(F.log2("tokens") * 16)
    sizes = sorted(((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count("word").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for value, n in sizes:
        if held + n > limit:
            break
        least, held = value, held + n
    rows = [] if least is None else counts.filter(step >= least).collect()
    words = np.array([r.word for r in rows], "<i8")
    order = np.argsort(words)
    return words[order], np.array([r.tokens for r in rows], "<i8")[order]


def fit(docs: DataFrame, train: Column, buckets: int = BUCKETS, rounds: int = ROUNDS, trainers: int | None = None, rate: float = 0.15,
        head_words: int = HEAD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """Learn from all documents for which ``train`` (over column ``_id``) holds; each is in one round.

    ``trainers`` (default: four per core of the cluster) bounds the messages of
    a round: each sends all weights in rows of a fixed size. Without training
    documents the classes are uniform and every word is unseen.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).filter(train)
    counts = count_words(rows)
    low = F.col("word").bitwiseAND(F.lit(CLASSES - 1))
    tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counts.groupBy(low.alias("kind")).agg(F.sum("tokens").alias("tokens"), F.count("word").alias("words")).collect():
        tokens[r.kind], words[r.kind] = r.tokens, r.words
    trainers = trainers or 4 * spark.sparkContext.defaultParallelism
    weights = np.zeros((buckets, CLASSES), np.float32)
    prior = (tokens + 1.0) / (tokens + 1.0).sum()
    bias = np.log(prior).astype(np.float32)
    schema = "chunk long, tokens long, change binary"
    for k in range(rounds if tokens.any() else 0):
        shared = spark.sparkContext.broadcast((weights, bias))
        mine = rows.filter(F.pmod(F.xxhash64("_id", F.lit("round")), F.lit(rounds)) == k).select("_text").coalesce(trainers)
        sums = mine.mapInArrow(_trainer(shared, buckets, rate), schema).groupBy("chunk").applyInArrow(_mean, schema).collect()
        shared.unpersist()
        table = np.concatenate([weights, bias[None]])
        for r in sums:
            change = np.frombuffer(r.change, "<f4").reshape(-1, CLASSES)
            table[r.chunk * _CHUNK: r.chunk * _CHUNK + len(change)] += change
        weights, bias = table[:-1].copy(), table[-1].copy()
    return LanguageModel(weights, bias, tokens, words, _head(counts, head_words), counts)


def _trainer(shared, buckets: int, rate: float):
    """Steps over one partition's documents; sends the change of the weights in chunks."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, start_bias = shared.value
        weights, bias = start.copy(), start_bias.copy()
        memory, seen, waiting, held = np.full(buckets, 1.0, np.float32), 0, [], 0
        words = _words()

        def learn() -> None:
            spots, classes = contexts(waiting, buckets)
            for a in range(0, len(classes), _BATCH):
                gradient_step(weights, bias, memory, spots[a: a + _BATCH], classes[a: a + _BATCH], rate)

        for batch in batches:
            for ids in words.of(batch):
                waiting.append(ids)
                held += len(waiting[-1])
                if held >= _BATCH:
                    learn()
                    seen, waiting, held = seen + held, [], 0
        if waiting:
            learn()
            seen += held
        if seen:
            change = np.concatenate([weights - start, (bias - start_bias)[None]]).astype("<f4")
            for c, a in enumerate(range(0, len(change), _CHUNK)):
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([seen]), pa.array([change[a: a + _CHUNK].tobytes()], pa.binary())],
                                                 names=["chunk", "tokens", "change"])

    return train


def _mean(table: pa.Table) -> pa.Table:
    """The mean change of one chunk over the trainers, by tokens; a group has one row per trainer."""
    tokens = table["tokens"].to_pylist()
    total = sum(np.frombuffer(c.as_py(), "<f4") * (n / sum(tokens)) for c, n in zip(table["change"], tokens))
    return pa.table({"chunk": table["chunk"][:1], "tokens": [sum(tokens)], "change": pa.array([total.astype("<f4").tobytes()], pa.binary())})


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score), one per input row; all logarithms are decimal.

    ``base_score`` is the add-one unigram score, ``score`` the model's. A null
    or empty text is its end alone. Words outside the broadcast head are looked
    up by a join on the word, whose keys are rare by construction.
    """
    spark = docs.sparkSession
    log_tokens = np.log10(model.class_tokens + model.class_words + 1.0)
    all_tokens = float(np.log10(model.tokens + model.words + 1))
    shared = spark.sparkContext.broadcast((model.weights, model.bias, log_tokens, *model.head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, inside, head, head_tokens = shared.value
        head_logs, words, buckets = np.log10(head_tokens + 1.0), _words(), len(weights)
        for batch in batches:
            out = []
            group, held = [], 0
            for k, ids in enumerate(words.of(batch)):
                group.append(ids)
                held += len(group[-1])
                if held >= _BATCH or k == batch.num_rows - 1:
                    out += _score_group(group, weights, bias, inside, head, head_logs, buckets)
                    group, held = [], 0
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch["_id"], *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                                             names=["doc_id", "n_tokens", "known", "logs", "gain", "rare"])

    scored = texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, known long, logs double, gain double, rare binary")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scores")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                found = [np.frombuffer(r.as_py(), "<i8") for r in some["rare"]]
                row = np.repeat(some["row"].to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.concatenate(found))], names=["row", "word"])

    rare = scored.filter(F.length("rare") > 0).select("row", "rare").mapInArrow(explode, "row long, word long")
    met = rare.join(model.counts, "word").groupBy("row").agg(
        F.count("word").alias("rare_known"), F.sum(F.log10(F.col("tokens") + 1)).alias("rare_logs"))
    base = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(all_tokens)
    return scored.join(met, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (base + F.col("n_tokens") * F.lit(all_tokens) + F.col("gain")).alias("score"))


def _score_group(ids: list[np.ndarray], weights, bias, inside, head, head_logs, buckets: int) -> list[tuple]:
    """Per text: tokens, tokens in the head, their log counts, the class part of the score, and the ids outside the head."""
    rows, classes = contexts(ids, buckets)
    gain = np.empty(len(classes))
    for a in range(0, len(classes), _BATCH):
        part = classes[a: a + _BATCH]
        gain[a: a + _BATCH] = own_log_probabilities(weights, bias, rows[a: a + _BATCH], part)
    gain = gain / np.log(10) - inside[classes]
    every = np.concatenate(ids).view("<i8")
    if len(head):
        spot = np.minimum(np.searchsorted(head, every), len(head) - 1)
        known = head[spot] == every
        logs = np.where(known, head_logs[spot], 0.0)
    else:
        known, logs = np.zeros(len(every), bool), np.zeros(len(every))
    ends = np.cumsum([len(x) for x in ids])
    out, a = [], 0
    for b in ends:
        out.append((int(b - a), int(known[a:b].sum()), float(logs[a:b].sum()), float(gain[a:b].sum()), every[a:b][~known[a:b]].tobytes()))
        a = b
    return out
