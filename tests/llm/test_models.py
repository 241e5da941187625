"""Quality and toxicity models, token counts: held-out accuracy and brute force."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from glasswork.llm import importance, queries, toxicity
from glasswork.llm.token_counts import UnigramCounter, count_tokens, load_vocabulary

ODD = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "", "y"), (3, "word " * 30000, None), (4, ".!? \n", "z")]


def odd_docs(spark, rows=ODD):
    return spark.createDataFrame([(*r, 1.0, "n") for r in rows], "doc_id long, text string, source string, score double, _id string")


def reference_tokenizer(vocabulary, byte_fallback):
    t = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def pieces():
    return load_vocabulary(queries.tokenizer_path(queries.TOKENIZER_UNIGRAM))


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.sampled_from("abcde é日\U0001F600▁ \n"), max_size=25), bytes_too=st.booleans())
def test_counts_with_ties(text, bytes_too):
    vocabulary = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -3.0), ("c", -1.0),
                  ("▁a", -3.0), ("bc", -1.0), ("cde", -2.5), ("d", -0.5)]
    if bytes_too:
        vocabulary += [(f"<0x{b:02X}>", -9.0) for b in range(256)]
    assert UnigramCounter(vocabulary, bytes_too)(text) == reference_tokenizer(vocabulary, bytes_too)(text)


@settings(max_examples=100, deadline=None)
@given(text=st.text(max_size=40))
def test_counts_with_real_pieces(pieces, text):
    counter = test_counts_with_real_pieces.__dict__.setdefault("counter", UnigramCounter(pieces))
    want = test_counts_with_real_pieces.__dict__.setdefault("want", reference_tokenizer(pieces, True))
    assert counter(text) == want(text)


def test_count_tokens(spark, sf, pieces):
    want = reference_tokenizer(pieces, True)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in queries.op2_token_counts(spark, sf).collect()}
    assert got == {r.doc_id: want(r.text) for r in docs.collect()}
    path = queries.tokenizer_path(queries.TOKENIZER_UNIGRAM)
    odd = [tuple(r) for r in count_tokens(odd_docs(spark), path).collect()]
    assert sorted(odd, key=str) == sorted([(i, want(t or "")) for i, t, _ in ODD], key=str)
    assert count_tokens(odd_docs(spark, []), path).collect() == []


def test_importance_against_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = importance.fit(docs, labels)
    rows, good = docs.collect(), {r.doc_id for r in labels.collect() if r.quality == 1}
    raw, wanted, ngrams = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS), importance.NgramBuckets()
    for r in rows:
        np.add.at(raw, ngrams(r.text), 1)
        if r.doc_id in good:
            np.add.at(wanted, ngrams(r.text), 1)
    ratio = np.log(wanted / wanted.sum()) - np.log(raw / raw.sum())
    assert np.allclose(model.log_ratio, ratio)
    scores = {r.doc_id: r for r in importance.score(docs, model).collect()}
    assert all(abs(scores[r.doc_id].log_weight - ratio[ngrams(r.text)].sum()) < 1e-6 for r in rows)
    keys = sorted((r.key for r in scores.values()), reverse=True)
    for k in (1, 17, len(rows) - 1, len(rows), 0):
        got = importance.resample(docs, model, k).collect()
        assert sorted((r.key for r in got), reverse=True) == keys[:k]
    kept = importance.keep_sampled(docs, model, 17)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in scores.items() if r.key >= keys[16]}


def test_importance_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in queries.op3_importance_resampling(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    bad = [r.doc_id in kept for r in labels if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_gumbel_sampling_follows_importance(spark):
    model = importance.ImportanceModel(np.zeros(importance.BUCKETS), 0.5)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    first = {r.doc_id for r in importance.resample(docs, model, 2000, seed=1).collect()}
    second = {r.doc_id for r in importance.resample(docs, model, 2000, seed=2).collect()}
    assert len(first) == len(second) == 2000 and 900 < len(first & second) < 1100


def test_importance_odd_inputs(spark):
    docs, none = odd_docs(spark), odd_docs(spark, [])
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    model = importance.fit(docs, labels)
    assert model.target_share == 0.5
    assert importance.score(docs, model).count() == len(ODD)
    assert importance.resample(none, model).collect() == [] and importance.keep_sampled(none, model).collect() == []
    assert importance.fit(docs, labels.limit(0)).log_ratio.any() == False  # noqa: E712
    assert importance.keep_sampled(docs, model, 100).count() == len(ODD)


def test_toxicity_held_out():
    """Noisy-or and its gradient against finite differences."""
    rng = np.random.default_rng(0)
    features, starts = rng.integers(0, 20, 30), np.array([0, 4, 11, 25])
    weights, bias = rng.normal(size=20), -1.0
    z = toxicity._sentence_logits(weights, bias, features, starts)
    s = 1 / (1 + np.exp(-z))
    assert abs(toxicity.bag_score(z) - (1 - np.prod(1 - s))) < 1e-12
    chunks = np.split(features, starts[1:])
    assert np.allclose(z, [bias + weights[c].sum() for c in chunks])
    kept = rng.random(20) < 0.5
    only, at, _ = toxicity._only((features, starts, 1), kept)
    assert [c.tolist() for c in np.split(only, at[1:])] == [c[kept[c]].tolist() for c in chunks if kept[c].any()]


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    r = scored.selectExpr("sum(predicted * toxic) tp", "sum(predicted) p", "sum(toxic) t", "min(score) low", "max(score) high").first()
    assert r.tp / r.p > 0.9 and r.tp / r.t > 0.8 and 0 <= r.low and r.high <= 1


def test_toxicity_odd_inputs_and_sentences(spark):
    rows = [(i, ("A calm line. " * (i % 5)) + ("You idiot there. " if i % 3 == 0 else "") + "The end.", "s") for i in range(90)]
    docs = odd_docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, buckets=1 << 12, parts=2, rounds=3)
    found = toxicity.offending_sentences(docs, model).collect()
    assert {r.doc_id for r in found} == {i for i in range(90) if i % 3 == 0}
    assert all("idiot" in r.sentence and dict((a, b) for a, b, _ in rows)[r.doc_id][r.start: r.end] == r.sentence for r in found)
    odd = toxicity.score(odd_docs(spark), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(odd_docs(spark, []), model).collect() == []
    nothing = toxicity.fit(docs, labels.limit(0), buckets=1 << 12)
    assert not nothing.weights.any()


def test_length_makes_no_document_toxic(spark):
    """A clean document of thousands of sentences stays clean, one with a single toxic sentence does not."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels, where=F.crc32(F.col("_id").cast("string")) % 3 != 1)
    words = "The river runs past the old mill. We walked along it in the morning. "
    toxic = docs.join(labels.filter("toxic = 1").select("doc_id"), "doc_id")
    worst = toxicity.offending_sentences(toxic, model, 0.9).orderBy(F.desc("score"), "doc_id", "start").first().sentence
    rows = spark.createDataFrame([(1, words * 2500), (2, words * 10), (3, words * 10 + worst)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(rows, model).collect()}
    assert [got[i].predicted for i in (1, 2, 3)] == [0, 0, 1], (model.bias, [got[i].score for i in (1, 2, 3)])
    assert got[1].score == got[2].score and got[1].n_sentences == 5000
