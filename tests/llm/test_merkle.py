"""The manifest against plain folding, its proofs against tampering, and SQL."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from compare import difference
from pyspark.sql import functions as F

from glasswork.llm import merkle, queries
from glasswork.llm.merkle import build_manifest, depth_of, fold, leaf_digest, prove

NAMES = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    """The root digest and per leaf the siblings of each level."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place - place % 3: place - place % 3 + 3]
            paths[i].append((place % 3, run[:place % 3] + run[place % 3 + 1:]))
            at[i] = place // 3
        level = [h(*level[i: i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def folded(digest, path):
    for digit, others in path:
        digest = h(*others[:digit], digest, *others[digit:])
    return digest


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root of the tampered row) by folding lists."""
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in sources[s]]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for r, path in zip(sources[s], trees[s][1]):
            full = path + top
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            claim = leaf((*r[:4], r[4].replace("\n", ""))) if even else leaf(r)
            out.append((r[0], leaf(r), trees[s][0], root, h(*[x for _, o in full for x in o]), folded(claim, full)))
    return sorted(out, key=str)


def rows_of(n, sources):
    return [(i, sources[i * i % len(sources)], "en" if i % 5 else None, i * 3, None if i % 11 == 0 else f"text {i}\nof é日" * (i % 4)) for i in range(n)]


ODD = [(None, None, None, None, None), (None, None, None, None, None), (4, "é", "", 0, ""), (4, "é", "", 0, ""), (4, "é", "", 0, "b\n"),
       (5, "", "x", 1, "\n"), (7, "日", "x", 1, "long\n" * 100_000), (-3, "a", None, -1, "-"), (2, "Z", "x", None, "\n\n")]


def attest(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", "y", 0) for r in rows],
                                 "doc_id long, source string, lang string, n_chars long, text string, place int, leaf_ string, tree_ string, step int")
    columns = [F.col(c) for c in NAMES]
    clean = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest = build_manifest(docs.select("doc_id", "source", "step", leaf_digest(*columns).alias("leaf"), leaf_digest(*columns[:4], clean).alias("claim")))
    proofs = prove(manifest, manifest.leaves.select("tree", "place", "doc_id", "claim"))
    out = fold(manifest, proofs, "claim").withColumn("root", F.lit(manifest.root))
    return manifest, sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root").collect()), key=str)


@pytest.mark.parametrize("rows", [
    ODD, ODD[:1], ODD[2:4], rows_of(1, ["a"]), rows_of(3, ["a"]), rows_of(4, ["a"]), rows_of(900, ["hot", "hot", "hot", "b", None, "", "é"]),
    rows_of(40, [f"s{i}" for i in range(37)])], ids=["odd", "one", "copies", "single", "run", "uneven", "hot", "many"])
def test_against_plain_folding(spark, rows, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "_SPAN", 9)
    assert attest(spark, rows)[1] == plain(rows)


def test_production_segments(spark):
    rows = rows_of(800, ["a", "a", "a", "b"])
    assert attest(spark, rows)[1] == plain(rows)


def test_nothing(spark):
    manifest, rows = attest(spark, [])
    assert manifest.root is None and rows == [] and manifest.records.count() == 0


def test_records_lead_from_the_root_to_every_leaf(spark):
    """The stored records alone: each digest is that of its children, and all leaves hang below the root."""
    rows = rows_of(300, ["a", "b", "b"])
    manifest, _ = attest(spark, rows)
    records = {r.digest: r.children for part in (manifest.records, manifest.top) for r in part.collect()}
    assert all(h(c) == d for d, c in records.items())
    below, level = set(), {manifest.root}
    while level:
        below |= level
        level = {records[d][i: i + 64] for d in level if d in records for i in range(0, len(records[d]), 64)}
    assert {leaf(r) for r in rows} <= below


def test_some_requests(spark):
    """Only the asked leaves are answered, each time they are asked, and an unknown tree is not."""
    rows = rows_of(200, ["a", "b"])
    manifest, every = attest(spark, rows)
    asked = manifest.leaves.filter("doc_id IN (3, 8, 120)").select("tree", "place", "doc_id")
    got = prove(manifest, asked.unionAll(asked.filter("doc_id = 8")).unionAll(asked.filter("doc_id = 3").selectExpr("tree + 50", "place", "doc_id")))
    assert sorted(r.doc_id for r in got.collect()) == [3, 8, 8, 120]
    assert {tuple(r) for r in fold(manifest, got).select("doc_id", "leaf", "proof_sha256").collect()} == {
        (r[0], r[1], r[4]) for r in every if r[0] in (3, 8, 120)}
    assert {r.folded_root for r in fold(manifest, got).collect()} == {manifest.root}


def test_depth(spark):
    sizes = [0, 1, 2, 3, 4, 9, 10, 27, 28, 3**20, 3**20 + 1]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(depth_of(F.col("n"))).collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3, 3, 4, 20, 21]


def test_query(spark, duck, sf):
    sql = queries.oracle_sql()["op13_merkle_manifest"]
    assert difference(spark, duck, queries.op13_merkle_manifest, sql, sf) is None
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*NAMES).collect()]
    got = queries.op13_merkle_manifest(spark, sf).collect()
    assert sorted((tuple(r[:6]) for r in got), key=str) == plain(rows)
    assert all(r.verified == (r.folded_root == r.root) for r in got)
