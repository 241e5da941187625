"""Decontamination and near-duplicates against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from glasswork.llm import near_duplicates as nd, queries
from glasswork.llm.components import connected_components
from glasswork.llm.decontamination import HammingIndex, ItemIndex, Windows, drop_contaminated, find_items, grid_size
from glasswork.llm import pieces
from glasswork.llm.pieces import hashed_words, mix, words_of


def grams(text):
    w = words_of(text or "")
    return Counter(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similar(a, b):
    both = sum((a & b).values())
    return both / sum((a | b).values()) if both else 0.0


def classes(docs):
    """Smallest id per class by comparing every pair of texts."""
    profiles = {t: grams(t) for _, t in docs}
    found = list(profiles)
    parent = {t: t for t in found}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    index = defaultdict(set)
    for t in found:
        for g in profiles[t]:
            index[g].add(t)
    for t in found:
        for other in set().union(*[index[g] for g in profiles[t]]) if profiles[t] else ():
            if root(t) != root(other) and similar(profiles[t], profiles[other]) >= 0.8:
                parent[root(t)] = root(other)
    least = {}
    for i, t in docs:
        r = root(t)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, least[root(t)]) for i, t in docs), key=str)


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.random():.6f}"[:10].replace(".", "")
    return " ".join(words)


def planted(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 260))]
        docs += [edited(base, rng, rng.randint(0, 3)) for _ in range(rng.choice([1, 2, 5, 40]))]
    docs += [" ".join([*[rng.choice(vocabulary) for _ in range(90)], *passage]) for _ in range(30)]
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for k in range(14):
        docs.append(" ".join(chain))
        chain = [*chain[8:], *[rng.choice(vocabulary) for _ in range(8)]]
    docs += ["", "", "one two", "one two", "One, TWO!", "..", "..", "x " * 3000, "x " * 3500]
    rng.shuffle(docs)
    return list(enumerate(docs))


def odd(spark, rows):
    return spark.createDataFrame([(*r, "n", "m", 1) for r in rows], "doc_id long, text string, node string, md5 string, _id int")


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 7)
    docs = planted()
    got = sorted(((r.doc_id, r.class_id) for r in nd.near_duplicates(odd(spark, docs)).collect()), key=str)
    assert got == classes(docs)


def test_near_duplicates_odd_inputs(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "alone here"), (1, None), (2, "")]
    got = sorted(((r.doc_id, r.class_id, r.copies) for r in nd.near_duplicates(odd(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 5, 3), (5, 5, 3), (None, 5, 3), (None, None, 1), (1, 1, 2), (2, 1, 2)], key=str)
    assert nd.near_duplicates(odd(spark, [])).collect() == []


def test_query_near_duplicates(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.class_id) for r in queries.op7_near_duplicates(spark, sf).collect()), key=str)
    assert got == classes(docs)


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    a = (np.unique(rng.integers(0, 2**63, 400).astype(np.uint64)), None)
    keys = a[0]
    wa, wb = rng.integers(0, 4, len(keys)), rng.integers(0, 4, len(keys))
    one, two = (keys[wa > 0], wa[wa > 0]), (keys[wb > 0], wb[wb > 0])
    sig = nd.signatures([one, two, one], 4000)
    both = (wa > 0) & (wb > 0)
    exact = sum(1 / np.maximum(wa / wa[d], wb / wb[d]).sum() for d in np.flatnonzero(both))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03
    assert (sig[0] == sig[2]).all()


def test_intersections_of_all_pairs():
    rng = np.random.default_rng(4)
    profiles = [nd.weighted(rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint64)) for _ in range(25)]
    got = nd.intersections(profiles)
    for i, a in enumerate(profiles):
        for j, b in enumerate(profiles):
            if i != j:
                x, y = dict(zip(*map(list, a))), dict(zip(*map(list, b)))
                assert got[i, j] == sum(min(x[k], y[k]) for k in x.keys() & y.keys())


def test_early_stop_equals_all_arrivals():
    """Registers equal those of a plain loop over one process after the other."""
    rng = np.random.default_rng(2)
    keys, weights = np.unique(rng.integers(0, 2**63, 30).astype(np.uint64)), None
    weights = rng.integers(1, 5, len(keys))
    m, first, winner = 16, np.full(16, np.inf), np.zeros(16, np.uint64)
    for key, w in zip(keys, weights):
        t, n = 0.0, 0
        while t < 5:
            n += 1
            r = mix(np.array([key]) + np.uint64(n * int(nd._C1) % 2**64))
            t -= np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)[0] / w
            k = int(mix(r + nd._C2)[0] % np.uint64(m))
            if t < first[k]:
                first[k], winner[k] = t, key
    assert (nd.signatures([(keys, weights)], m)[0] == winner).all()


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(9, 2), (5, 9), (7, 8)]])
def test_components(spark, edges):
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        if a != b:
            low = {want.get(a, a), want.get(b, b)}
            for x in [*want, a, b]:
                if want.get(x, x) in low:
                    want[x] = min(low)
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30), st.integers(1, 29))
def test_bit_sliced_windows(values, size):
    hashes = np.array(values, np.uint64)
    got = Windows(hashes).fingerprints(size)[: max(0, len(values) - size + 1)].tolist()
    bits = [int(x) for x in mix(hashes)]
    want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in bits[i: i + size]) > size) for i in range(len(values) - size + 1)]
    assert got == want


def test_hamming_index_is_complete():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**64, 60, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 11), replace=False)) for _ in range(3000)]
    query = prints[rng.integers(0, 60, 3000)] ^ np.array(flips, np.uint64)
    q, e = HammingIndex(prints).search(query)
    want = np.argwhere(np.bitwise_count(query[:, None] ^ prints[None]) <= 7)
    assert np.column_stack([q, e]).tolist() == want.tolist()
    assert [len(x) for x in HammingIndex(prints[:0]).search(query)] == [0, 0]


def test_grid():
    assert [grid_size(n) for n in (1, 2, 5, 6, 14, 59)] == [1, 2, 5, 6, 14, 52]


def best_windows(text, item):
    h, want = words_of(text or ""), grams(item)
    n = len(words_of(item or ""))
    if not n or len(h) < n:
        return 0.0
    return max(similar(grams(" ".join(h[i: i + n])), want) for i in range(len(h) - n + 1))


def test_decontamination_against_all_windows(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 70)))) for i in range(25)] + [(90, None), (91, "a b"), (92, "..")]
    docs = []
    for d in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        if d % 3 == 0:
            words = items[rng.randrange(25)][1].split()
            if d % 2:
                words[rng.randrange(len(words))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + "," for w in words]
        docs.append((d, "\n".join([" ".join(body[:20]), " ".join(body[20:])])))
    docs += [(500, None), (501, ""), (None, "A b!"), (501, items[0][1]), (501, items[0][1])]
    frame = odd(spark, docs)
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, _text string")
    got = [(r.doc_id, r.item_id, round(r.similarity, 9)) for r in find_items(frame, bench).collect()]
    want = [(d, i, round(s, 9)) for d, t in docs for i, x in items if (s := best_windows(t, x)) >= 0.8]
    assert sorted(got, key=str) == sorted(want, key=str)
    clean = [tuple(r)[:2] for r in drop_contaminated(frame, bench).collect()]
    dirty = [(d, t) for d, t in docs if any(best_windows(t, x) >= 0.8 for _, x in items)]
    assert sorted(clean, key=str) == sorted([d for d in docs if d not in dirty], key=str)
    assert find_items(frame, bench.limit(0)).collect() == [] and find_items(odd(spark, []), bench).collect() == []
    assert drop_contaminated(frame, bench.limit(0)).count() == len(docs)


def test_query_decontamination(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, sf).collect()}
    plain = {d.doc_id: f" {' '.join(words_of(d.text))} " for d in docs}
    verbatim = {(d, i.item_id) for d, t in plain.items() for i in items if f" {' '.join(words_of(i.text))} " in t}
    assert verbatim and verbatim <= got
    texts, bench = {d.doc_id: d.text for d in docs}, {i.item_id: i.text for i in items}
    assert all(best_windows(texts[d], bench[i]) >= 0.8 for d, i in got - verbatim)


def test_item_blocks_agree(spark, sf, monkeypatch):
    from glasswork.llm import decontamination

    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, find_items(docs, items).collect()))
    monkeypatch.setattr(decontamination.item_blocks, "__defaults__", (4000,))
    assert sorted(map(tuple, find_items(docs, items).collect())) == one
    assert isinstance(ItemIndex([]).sizes, dict)


@pytest.mark.parametrize("lengths", [range(15, 31), range(31, 46), range(46, 61)])
def test_one_word_changed_at_each_place(lengths):
    """Every copy that is similar enough is found, for every length of an item."""
    rng = random.Random(11)
    for n in lengths:
        item = [f"i{rng.random():.9f}"[:9].replace(".", "") for _ in range(n)]
        copies = [[*item[:k], f"other{k}", *item[k + 1:]] for k in range(n)]
        texts = [" ".join([*["before"] * 3, *c, *["after"] * 3]) for c in [item, *copies]]
        want = {0} | {k + 1 for k, c in enumerate(copies) if similar(grams(" ".join(item)), grams(" ".join(c))) >= 0.8}
        got = list(ItemIndex([(7, " ".join(item))]).search(texts))
        assert {t for t, *_ in got} == want, n


@given(st.lists(st.text(alphabet="aBcÀΣσßİ中9_ .\n\t-", max_size=60), max_size=6), st.sampled_from([4, 64, 1 << 16]))
@settings(max_examples=150, deadline=None)
def test_hashed_words_are_the_words(found, stretch):
    """Equal words and only those have equal hashes, wherever texts and stretches are cut."""
    before, pieces._STRETCH = pieces._STRETCH, stretch
    try:
        hashes, lengths = hashed_words(found)
    finally:
        pieces._STRETCH = before
    words = [w for t in found for w in words_of(t)]
    assert lengths.tolist() == [len(words_of(t)) for t in found] and len(hashes) == len(words)
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))


def test_hashed_words_long_and_foreign():
    long = ["a" * 64, "a" * 65, "b" * 65, "ab" * 50_000, "é" + "ab" * 50_000]
    text = " ".join([*long, "word"])
    hashes, lengths = hashed_words(["word", text, ""])
    assert lengths.tolist() == [1, 6, 0] and hashes[0] == hashes[-1] and len(set(hashes.tolist())) == 6
    assert hashed_words(["Word"])[0][0] == hashes[0]


def test_search_makes_no_word_and_verifies_few_windows(monkeypatch):
    """Words are not hashed one by one, and windows that cannot be similar enough are not compared."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=26))) for i in range(100)]
    texts = [" ".join(rng.choices(vocabulary, k=2000)) for _ in range(20)]
    texts[3] += " " + items[7][1]
    calls = Counter()

    def counted(name, fn):
        monkeypatch.setattr(name, lambda *a: (calls.update([name]), fn(*a))[1])

    from glasswork.llm import decontamination as dc

    counted("glasswork.llm.pieces.word_hash", pieces.word_hash)
    counted("glasswork.llm.decontamination.weighted_jaccard", dc.weighted_jaccard)
    assert list(ItemIndex(items).search(texts)) == [(3, 7, 2000, 1.0)]
    assert calls["glasswork.llm.pieces.word_hash"] == 0
    assert calls["glasswork.llm.decontamination.weighted_jaccard"] <= 5
