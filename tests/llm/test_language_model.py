"""The language model: exact base scores, a proper distribution, and held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glasswork.llm import language_model as lm, queries

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*SPLIT.findall(low), None]


def expected(docs, held):
    counts = Counter(w for i, t in docs if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in docs:
        tokens = words(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        yield i, len(tokens), sum(counts[w] > 0 for w in tokens), n, base


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, word long, tokens long, known string")


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op9_language_model(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, n, known, train, base in expected(docs, is_held):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held(i), n, known, train)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in got.values() if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.05  # decimal orders per held-out token


def test_odd_inputs(spark):
    rows = [(1, "A b\x0bc d É É"), (1, "A b\x0bc d É É"), (2, None), (None, ""), (3, "z " * 20000), (4, "never seen")]
    train = F.coalesce(F.col("_id") != 4, F.lit(True))
    model = lm.fit(frame(spark, rows), train, buckets=512, trainers=2, head_words=2)
    assert len(model.head[0]) <= 2
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score(frame(spark, rows), model).collect()]
    want = [(*x[:4], round(x[4], 6)) for x in expected(rows, lambda i: i == 4)]
    assert sorted(got, key=str) == sorted(want, key=str)
    nothing = lm.fit(frame(spark, []), F.lit(True))
    assert lm.score(frame(spark, []), nothing).collect() == []
    alone = lm.score(frame(spark, rows), nothing).collect()
    assert all(r.n_known == 0 and r.base_score == 0 and np.isfinite(r.score) for r in alone)


def test_probabilities_add_up(spark):
    """Over all training words and one unseen place per class, the chance of the next word is one."""
    rows = [(i, f"a{i % 3} b{i % 5} c d{i % 7}") for i in range(60)]
    model = lm.fit(frame(spark, rows), F.lit(True), buckets=256, trainers=2)
    ids = lm._words()("a1 b2")
    rows_, _ = lm.contexts([ids], 256)
    classes = np.exp(lm.class_log_probabilities(model.weights, model.bias, rows_[-1:]))[0]
    counts = {r.word: r.tokens for r in model.counts.collect()}
    inside = np.zeros(lm.CLASSES)
    for word, n in counts.items():
        inside[word & (lm.CLASSES - 1)] += n + 1
    inside = (inside + 1) / (model.class_tokens + model.class_words + 1)
    assert abs((classes * inside).sum() - 1) < 1e-5
    assert np.allclose(inside, 1)


def test_words_of_slices():
    """Words of several texts at once; a distinct one is hashed once, whatever its case and its gaps."""
    made, ids = [], lm.WordIds()
    make, ids.cache.make = ids.cache.make, lambda w: made.append(w) or make(w)
    ids.cache.limit = 1
    rows = ["cut off", "A b\x0bc\x1cd É\u00a0é  a", "", " \t\r\n", "B\x0cb A", "日本 a"]
    got = list(ids.of(pa.RecordBatch.from_pydict({"_text": rows}).slice(1)))
    plain = [b"".join(map(make, t.encode().lower().split())) + bytes(8) for t in rows[1:]]
    assert [g.tobytes() for g in got] == plain
    assert sorted(made) == sorted({w for t in rows[1:] for w in t.encode().lower().split()})
    assert list(ids.of(pa.RecordBatch.from_pydict({"_text": [""]}).slice(0, 0))) == []


def test_sums_of_runs():
    rng = np.random.default_rng(2)
    values, sizes = rng.normal(size=(300, 4)), np.array([90, lm._RUN + 1, lm._RUN, 3, 1, 1])
    order = rng.integers(0, 300, sizes.sum())
    first = np.cumsum(sizes) - sizes
    assert np.allclose(lm._run_sums(values, order, first, sizes), np.add.reduceat(values[order], first, axis=0))


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    rows, classes = rng.integers(0, 8, (5, 3)), rng.integers(0, lm.CLASSES, 5)
    weights, bias = rng.normal(size=(8, lm.CLASSES)), rng.normal(size=lm.CLASSES)
    value = lambda w: lm.class_log_probabilities(w.copy(), bias, rows)[np.arange(5), classes].sum()
    moved, memory = weights.copy(), np.full(8, 1e30)
    lm.gradient_step(moved, bias.copy(), memory, rows, classes, 1e15)
    grad = moved - weights
    for r, c in [(0, 3), (5, 10), (7, 63)]:
        up = weights.copy()
        up[r, c] += 1e-6
        assert abs((value(up) - value(weights)) / 1e-6 - grad[r, c]) < 1e-4


def test_own_probabilities_without_overflow():
    rng = np.random.default_rng(1)
    rows, classes = rng.integers(0, 8, (50, 3)), rng.integers(0, lm.CLASSES, 50)
    for scale in (1, 40):
        weights = (rng.normal(size=(8, lm.CLASSES)) * scale).astype(np.float32)
        bias = np.zeros(lm.CLASSES, np.float32)
        full = weights[rows].sum(1).astype(float)
        want = (full - np.log(np.exp(full - full.max(1, keepdims=True)).sum(1))[:, None] - full.max(1, keepdims=True))[np.arange(50), classes]
        assert np.allclose(lm.own_log_probabilities(weights, bias, rows, classes), want, atol=1e-3)
