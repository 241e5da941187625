"""The last-token table against the sentencepiece library."""

import hashlib
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor

from glasswork.llm import prefix_table, queries
from glasswork.llm.prefix_table import PrefixTable, decode_ids, encode_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
TABLE = PrefixTable(PATH)


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(st.sampled_from("aeinrst th.\n▁ é日𝔘\x00'<0x>A-="), max_size=80)))
def test_ids_are_the_library_s(text):
    assert TABLE(text).tolist() == LIBRARY.encode(text)
    assert TABLE.decode(TABLE(text)) == LIBRARY.decode(LIBRARY.encode(text))


@pytest.mark.parametrize("text", [" " * 1000, "▁" * 37 + "a", "ab" * 40_000, "the quick\n" * 5000, "\U0001F600\U0001F601" * 3000, "=" * 9999])
def test_long_runs(text):
    assert TABLE(text).tolist() == LIBRARY.encode(text)


def test_last_tokens_are_those_of_every_prefix():
    """Each entry is the last token of its prefix encoded alone (the library adds the mark in front)."""
    word = "▁internationalization.\nées日x"
    last = TABLE.last_tokens(word)
    for end in range(2, len(word) + 1):
        ids = LIBRARY.encode(word[1:end])
        packed = array("I", TABLE.packed[last[end]]).tolist()
        assert ids[-len(packed):] == packed


def test_a_forgotten_pair_is_tested_again(monkeypatch):
    monkeypatch.setattr(prefix_table, "CACHED_PAIRS", 3)
    small = PrefixTable(PATH)
    text = "Several words that share few pairs, and some numbers 12 345."
    assert small(text).tolist() == LIBRARY.encode(text) and small.tested <= 3


ROWS = [(3, "Hello there,  world\n x"), (1, None), (2, ""), (2, "twice"), (2, "twice"), (None, "no id <s>"), (9, "long " * 60_000)]


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_table, "_SLICE_CHARS", 20)
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in ROWS], "doc_id long, text string, ids string, decoded int, _id string")
    got = encode_texts(docs, PATH, decoded=True).collect()
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=str) == sorted(
        ((d, LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or ""))) for d, t in ROWS), key=str)
    again = decode_ids(encode_texts(docs, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.decoded) for r in again), key=str) == sorted(((r.doc_id, r.decoded) for r in got), key=str)
    assert encode_texts(docs.limit(0), PATH, decoded=True).collect() == []
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [tuple(r) for r in decode_ids(null, PATH).collect()] == [(1, "")]


def test_query(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = LIBRARY.encode(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())
    rows = queries.op11_sentencepiece(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want and len(rows) == len(want)
