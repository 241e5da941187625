"""The document scan against a plain ranking and against SQL."""

import math
import re
from collections import Counter

import pytest
from compare import difference
from hypothesis import given, settings, strategies as st

from glasswork.llm import document_scan, queries
from glasswork.llm.document_scan import TermScanner, rank_documents, terms_of

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    """(item_id, rank, doc_id, score), each item against each document."""
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item, text in items:
        scored = []
        for d, tf, n in held:
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (
                1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * (25 + 75 * n * n_docs // total))) for t in terms(text) if tf[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    left = spark.createDataFrame([(*d, 7, "x", 1) for d in docs], "doc_id long, text string, item_id int, score string, _id long")
    right = spark.createDataFrame([(*i, "q") for i in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in rank_documents(left, right, **more).collect()), key=str)


DOCS = [(5, "The cat sat. THE CAT"), (2, "the cat sat. the cat"), (2, "the cat sat. the cat"), (9, None), (8, ""), (7, "..."), (None, "cat"),
        (1, "caté cat's été ÉTÉ straße x_y"), (3, "dog " * 30_000 + "cat"), (4, "日本 cat\x00dog"), (6, "catalog cat5 5cat")]
ITEMS = [(1, "Cat"), (2, "the the dog"), (3, None), (4, ""), (5, "nowhere"), (6, "été x y 日本 s"), (1, "Cat"), (None, "sat 5CAT")]


def test_against_plain_ranking(spark):
    assert found(spark, DOCS, ITEMS) == plain(DOCS, ITEMS)
    assert found(spark, DOCS, ITEMS, k=2) == plain(DOCS, ITEMS, 2)


def test_in_small_slices_and_blocks(spark, monkeypatch):
    """Slices and blocks bound memory and change nothing."""
    monkeypatch.setattr(document_scan, "BLOCK_CHARS", 40)
    monkeypatch.setattr(document_scan, "_SLICE_BYTES", 17)
    monkeypatch.setattr(document_scan, "_CELLS", 12)
    assert found(spark, DOCS, ITEMS) == plain(DOCS, ITEMS)


def test_nothing(spark):
    assert found(spark, [], ITEMS) == [] and found(spark, DOCS, []) == [] and found(spark, [(1, None)], ITEMS) == []


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("aAbB é5.\n日Z-"), max_size=30), max_size=6), size=st.integers(1, 40))
def test_scanner_counts(texts, size):
    listed = [t.encode() for t in ("a", "ab", "é", "b5", "日z")]
    old, document_scan._SLICE_BYTES = document_scan._SLICE_BYTES, size
    try:
        folded = [t.encode().translate(document_scan._FOLD) for t in texts]
        lengths, text, term, times = TermScanner(listed)(folded)
    finally:
        document_scan._SLICE_BYTES = old
    assert [t.encode() for x in texts for t in terms(x)] == [t for x in texts for t in terms_of(x)]
    assert lengths.tolist() == [len(terms(t)) for t in texts]
    want = {(i, j): n for i, t in enumerate(texts) for j, w in enumerate(listed) if (n := terms(t).count(w.decode()))}
    assert dict(zip(zip(text.tolist(), term.tolist()), times.tolist())) == want


@pytest.mark.parametrize("name", ["op12_document_scan"])
def test_query(spark, duck, sf, name):
    assert difference(spark, duck, queries.queries()[name], queries.oracle_sql()[name], sf) is None
