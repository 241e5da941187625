"""The pipeline against a brute-force version of each stage, and the registration."""

import inspect
from collections import defaultdict

import numpy as np
import pytest
from test_duplicates import best_windows, classes
from test_secrets import base, linked
from test_tokens import check_pieces, plain

import __spark_entry__ as entry
import corpus_pipeline
from glasswork.llm import importance


def scrubbed(text):
    out, at = "", 0
    for s, _, e in sorted([x[:3] for x in base(text)] + list(linked(text))):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def quality_kept(docs, labels):
    """Ids by log ratio of counted n-grams plus Gumbel noise, largest first."""
    ngrams, size = importance.NgramBuckets(), importance.BUCKETS
    target = {r.doc_id for r in labels if r.quality == 1}
    raw, good = np.ones(size), np.ones(size)
    spots = {d.doc_id: ngrams(d.text) for d in docs}
    for i, s in spots.items():
        raw += np.bincount(s, minlength=size)
        if i in target:
            good += np.bincount(s, minlength=size)
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    noise = importance._scorer(importance.ImportanceModel(np.zeros(size), 1.0), 7)
    ids = [d.doc_id for d in docs]
    keys = noise(ids, [""] * len(ids))[2] + np.array([ratio[spots[i]].sum() for i in ids])
    k = round(len(target) / len({r.doc_id for r in labels}) * len(ids))
    least = np.sort(keys)[::-1][k - 1]
    return {i for i, x in zip(ids, keys) if x >= least}


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    names = docs.columns
    rows = docs.collect()

    one = corpus_pipeline.quality(spark, docs, sf)
    assert one.columns == names
    kept = one.collect()
    assert {r.doc_id for r in kept} == quality_kept(rows, labels)

    two = corpus_pipeline.deduplicate(spark, one, sf)
    groups = defaultdict(list)
    for i, c in classes([(r.doc_id, r.text) for r in kept]):
        groups[c].append(i)
    left = two.collect()
    assert two.columns == names and len(left) == len(groups)
    assert {next(c for c, ids in groups.items() if r.doc_id in ids) for r in left} == set(groups)

    three = corpus_pipeline.decontaminate(spark, two, sf)
    clean = [r for r in left if not any(best_windows(r.text, i.text) >= 0.8 for i in items)]
    assert three.columns == names and sorted(three.collect()) == sorted(clean)

    four = corpus_pipeline.scrub(spark, three, sf)
    masked = four.collect()
    assert four.schema == docs.schema
    assert {r.doc_id: r.text for r in masked} == {r.doc_id: scrubbed(r.text) for r in clean}
    assert all(r.n_chars == len(r.text) for r in masked)

    check_pieces(corpus_pipeline.pack(spark, four, sf).collect(), [(r.doc_id, r.source, r.text) for r in masked],
                 plain("word_bpe_49k.json"), 2048)


def test_run_chains_its_stages(spark, sf, monkeypatch):
    """Each stage gets what the one before returned, read back from a written table; the last result is returned."""
    seen = []

    def stage(name):
        def apply(session, docs, folder):
            assert session is spark and folder == sf
            plan = docs._jdf.queryExecution().optimizedPlan().toString()
            seen.append((name, docs.count(), "Filter" in plan))
            return docs.filter(docs.doc_id % (len(seen) + 1) != 0)
        return apply

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stage(n)) for n in "abc"])
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    done = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert done == {i for i in ids if i % 2 and i % 3 and i % 4}
    assert seen == [("a", len(ids), False), ("b", sum(i % 2 for i in ids), False), ("c", sum(i % 2 != 0 and i % 3 != 0 for i in ids), False)]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, 0), (1, "password=12345678", "en", None, 17), (1, "password=12345678", "en", None, 17),
                                       (2, "", None, "s", 0)]])
def test_odd_documents(spark, sf, rows):
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert corpus_pipeline.pack(spark, docs, sf).count() == docs.count()


def test_registration():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert [list(inspect.signature(f).parameters) for _, f in corpus_pipeline.STAGES] == [["spark", "docs", "sf_dir"]] * 5
    assert corpus_pipeline.ORACLE_SQL is None


def test_entry_without_the_subpackage(monkeypatch):
    def missing(name):
        raise ModuleNotFoundError(f"No module named {name!r}", name="glasswork.llm")

    monkeypatch.setattr(entry, "import_module", missing)
    assert entry.queries() and not any(n.startswith("op1_") for n in entry.queries())

    def broken(name):
        raise ModuleNotFoundError("No module named 'numpy'", name="numpy")

    monkeypatch.setattr(entry, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
