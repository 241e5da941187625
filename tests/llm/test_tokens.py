"""Encoding, token files and packing against the tokenizers library and brute force."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from glasswork.llm import queries
from glasswork.llm.inputs import slices
from glasswork.llm.packing import Plan, pack
from glasswork.llm.pieces import PieceCache
from glasswork.llm.token_files import document_ids, read_index, read_token_files, write_token_files
from glasswork.llm.tokenizing import TextEncoder, encoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ROWS = [(3, "b", "Hello there,  world\n x"), (1, "a", None), (2, None, ""), (2, "a", "twice"), (2, "a", "twice"),
        (None, "b", "no id <|endoftext|>"), (9, "c", "long " * 5000), (7, "a", "é ñ don't 12 34  \n\n z")]


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def frame(spark, rows=ROWS):
    schema = "doc_id long, source string, text string, _id string, ids string, part string, base string, n string"
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], schema)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(text=st.text(st.sampled_from("aBcé ñß\n\t.,'s!%9<|>-́Σİ\x1c\xa0　"), max_size=40))
def test_cut_texts_encode_as_whole(name, text):
    e = encoder(public_tokenizers.path(name))
    assert e(text) == e.whole(text)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("aBcé ñß\n\t.,'s!9<|>-\u0301×÷Σİ\x1c\x85\xa0\u3000日"), max_size=25), max_size=6))
def test_slices_encode_as_whole_texts(name, texts):
    e = encoder(public_tokenizers.path(name))
    want = [e.whole(t) + b"<end" for t in texts]
    assert e.encode(pa.array(["cut off", *texts], pa.string())[1:], b"<end").to_pylist() == want


@pytest.mark.parametrize("name", NAMES)
def test_equal_words_are_encoded_once(name):
    """Marks behind a word and capitals, where the tokenizer has none, make no new word; odd pieces are made once too."""
    e = TextEncoder(public_tokenizers.path(name))
    e.parts.clear()
    calls, tokenize, whole = [], e.tokenize, e.tokenizer.encode
    e.tokenize = lambda part: calls.append(part) or tokenize(part)
    text = " ".join(f"so {w}rdle{m}" for w in ("wo", "va", "éa") for m in ("", ".", ",", "!?", ".\nso", "9", "9")) + " " + "İ1 " * 50 + "end"
    odd = []
    e.whole = e.odd.make = lambda t: odd.append(t) or e.pack(whole(t, add_special_tokens=False).ids)
    assert e(text) == e.pack(whole(text, add_special_tokens=False).ids)
    assert len(calls) == len(set(calls)) <= 14
    assert len(odd) == 4


def test_rows_in_slices():
    rows = pa.RecordBatch.from_pydict({"x": ["a" * 30, "", "bcd", "é" * 10, "", "e"]})
    parts = list(slices(rows, "x", 20))
    assert [x for p in parts for x in p["x"].to_pylist()] == rows["x"].to_pylist()
    assert [p.num_rows for p in parts] == [1, 2, 2, 1]
    assert list(slices(rows.slice(0, 0), "x")) == []


def test_cache_is_bounded_and_exact():
    cache = PieceCache(lambda p: p.encode(), limit=10)
    words = [str(i % 37) for i in range(1000)]
    assert cache.join(words) == "".join(words).encode()
    assert len(cache) <= 10 and len(cache.old) <= 10


def test_token_files(spark):
    folder = write_token_files(frame(spark), public_tokenizers.path(NAMES[0]), partitions=3)
    encode = plain(NAMES[0])
    want, at = [], 0
    for doc, _, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[2] or "")):
        ids = np.array([*encode(text), 0], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in read_token_files(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    assert read_index(folder)["tokens"] == at
    doc, ids = document_ids(folder, 1)
    assert doc == want[1][0] and zlib.crc32(ids.astype("<u4").tobytes()) == want[1][3]


def test_token_files_of_nothing(spark):
    folder = write_token_files(frame(spark, []), public_tokenizers.path(NAMES[0]))
    assert read_token_files(spark, folder).collect() == []


def check_pieces(pieces, rows, encode, sequence):
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    want = defaultdict(list)
    for doc, _, text in rows:
        want[doc].append(np.array([*encode(text), 1], "<u4"))
    assert set(docs) == set(want)
    for doc, copies in want.items():
        assert sum(p.length for p in docs[doc]) == sum(map(len, copies))
        assert all(any(p.doc_tokens == len(c) and zlib.crc32(c[p.start: p.start + p.length].tobytes()) == p.ids_crc32
                       for c in copies) for p in docs[doc])
        if len(copies) == 1:
            at = 0
            for p in sorted(docs[doc], key=lambda p: p.start):
                assert p.start == at
                at += p.length
    sizes = []
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert all(n <= sequence and n & (n - 1) == 0 for n in sizes)
    assert sum(n < sequence for n in sizes) <= sequence.bit_length()


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.5}, {"c": 1.0}])
def test_pack(spark, targets):
    out = pack(frame(spark), public_tokenizers.path(NAMES[1]), targets=targets, sequence=64, window_sequences=2)
    check_pieces(out.collect(), ROWS, plain(NAMES[1]), 64)


def test_pack_nothing(spark):
    assert pack(frame(spark, []), public_tokenizers.path(NAMES[1])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 5000), min_size=1), st.integers(8, 300),
       st.one_of(st.none(), st.dictionaries(st.sampled_from("abcd"), st.integers(0, 9), min_size=1)))
def test_plan_fills_windows_to_target(totals, window, targets):
    plan = Plan(totals, targets, window, 16)
    taken, used = np.zeros(plan.tokens, bool), defaultdict(lambda: defaultdict(int))
    for s, n in totals.items():
        for a, size, place, w in plan.spots(s, 0, n):
            assert not taken[place: place + size].any()
            taken[place: place + size] = True
            used[w][s] += size
    assert taken.all()
    for phase in plan.phases:
        total = sum(phase["quantum"].values())
        for k in range(phase["run"] - 1):
            for s, q in phase["quantum"].items():
                assert abs(used[phase["first"] + k][s] - window * q / total) <= 1.01 + window * len(totals) / (1 << 40)


def test_queries(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()
    encode = plain(NAMES[0])
    want, at = [], 0
    for r in sorted(rows):
        ids = np.array([*encode(r.text), 0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op5_token_files(spark, sf).collect()) == want
    check_pieces(queries.op8_packing(spark, sf).collect(), rows, plain(NAMES[1]), 2048)
