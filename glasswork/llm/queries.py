"""Registered queries: each operator with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TOKENIZER_BYTES, TOKENIZER_WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
TOKENIZER_PIECES = "piece_bpe_32k.model"
# The one installed vocabulary of pieces with scores; op2 reads it as a unigram vocabulary.
TOKENIZER_UNIGRAM = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files lie; any other path can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    from glasswork.llm.decontamination import find_items

    return find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    from glasswork.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER_UNIGRAM))


def op3_importance_resampling(spark, sf_dir: str) -> DataFrame:
    from glasswork.llm.importance import fit, resample

    docs = _table(spark, sf_dir, "documents")
    return resample(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op4_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    from glasswork.llm.neighbour_graph import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    from glasswork.llm.token_files import read_token_files, write_token_files

    folder = write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER_BYTES), end_id=0)
    return read_token_files(spark, folder)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    from glasswork.llm.secrets import digest, find_secrets

    return digest(find_secrets(_table(spark, sf_dir, "documents")))


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    from glasswork.llm.near_duplicates import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    from glasswork.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER_WORDS), end_id=1)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_language_model(spark, sf_dir: str) -> DataFrame:
    from glasswork.llm.language_model import fit, score

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("_id").cast("string")) % 7 == 2, F.lit(False))
    scored = score(docs, fit(docs, ~held_out))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    from glasswork.llm.toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("_id").cast("string")) % 3 == 1
    model = fit(docs, _table(spark, sf_dir, "labels"), where=~held_out)
    scored = score(docs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_sentences", "worst")


def op11_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from glasswork.llm.prefix_table import encode_texts

    rows = encode_texts(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER_PIECES), decoded=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_document_scan(spark, sf_dir: str) -> DataFrame:
    from glasswork.llm.document_scan import rank_documents

    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    from glasswork.llm.merkle import build_manifest, fold, leaf_digest, prove

    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", leaf_digest(*columns, F.col("text")).alias("leaf"),
        leaf_digest(*columns, F.coalesce(tampered, F.col("text"))).alias("claim"))
    manifest = build_manifest(rows)
    proofs = prove(manifest, manifest.leaves.select("tree", "place", "doc_id", "claim"))
    root = F.lit(manifest.root)
    return fold(manifest, proofs, "claim").select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def pipeline(spark, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    import corpus_pipeline  # noqa: F401  (a missing pipeline is told at once)

    return {f.__name__: f for f in (
        op1_decontamination, op2_token_counts, op3_importance_resampling, op4_nearest_neighbours, op5_token_files, op6_secrets,
        op7_near_duplicates, op8_packing, op9_language_model, op10_toxicity, op11_sentencepiece, op12_document_scan,
        op13_merkle_manifest, pipeline)}


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
  items AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
  corpus AS (SELECT count(*) AS nn, CAST(sum(len(terms)) AS BIGINT) AS ll FROM docs WHERE len(terms) > 0),
  wanted AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(terms) AS term FROM items) GROUP BY ALL),
  tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY ALL),
  weights AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tfs, corpus GROUP BY term, nn),
  scored AS (SELECT i, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(terms) * nn) // ll)))) AS BIGINT) AS score
    FROM wanted JOIN tfs USING (term) JOIN weights USING (term) JOIN docs USING (r), corpus GROUP BY i, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
  FROM scored JOIN docs USING (r) JOIN items USING (i) WHERE score > 0) WHERE rank <= 10
"""


def _merkle_sql(levels: int = 16) -> str:
    """Both trees bottom up, level by level, then each leaf's siblings and the fold of its claim, level by level.

    A tree that is down to one digest stays as it is; 3^16 leaves and as many sources fit.
    """
    fields = " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in (
        "CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"))
    crc = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
        string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""
    parts = [f"""docs AS (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents)""",
             f"""leaves AS (SELECT doc_id, source, sha256({fields} || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256({fields} || coalesce(strlen(changed) || ':' || changed, '-')) AS claim FROM docs)""",
             """a0 AS (SELECT dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, leaf AS h, * FROM leaves)"""]

    def levels_of(name: str, group: str) -> None:
        for k in range(levels):
            parts.append(f"""{name}{k + 1} AS (SELECT {group}, place // 3 AS place, CASE WHEN any_value(n) = 1 THEN any_value(h)
        ELSE sha256(string_agg(h, '' ORDER BY place)) END AS h
        FROM (SELECT {group}, place, h, count(*) OVER (PARTITION BY {group}) AS n FROM {name}{k}) GROUP BY {group}, place // 3)""")

    def walk(name: str, group: str, place: str, before: str) -> str:
        """The fold of every claim up the levels of one forest: siblings left and right of the path."""
        for k in range(levels):
            now = f"{name}w{k}"
            parts.append(f"""{now} AS (SELECT f.* EXCLUDE (proof, claim), f.proof || coalesce(s.l, '') || coalesce(s.r, '') AS proof,
        CASE WHEN s.n > 1 THEN sha256(coalesce(s.l, '') || f.claim || coalesce(s.r, '')) ELSE f.claim END AS claim
        FROM {before} f JOIN (SELECT {group}, place, count(*) OVER (PARTITION BY {group}) AS n,
            string_agg(h, '') OVER (PARTITION BY {group}, place // 3 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
            string_agg(h, '') OVER (PARTITION BY {group}, place // 3 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r
            FROM {name}{k}) s ON s.{group} = f.{group} AND s.place = f.{place} // {3**k})""")
            before = now
        return before

    levels_of("a", "tree")
    parts.append(f"b0 AS (SELECT 0 AS forest, tree AS place, h FROM a{levels})")
    levels_of("b", "forest")
    parts.append("start AS (SELECT doc_id, leaf, claim, '' AS proof, tree, place, 0 AS forest FROM a0)")
    end = walk("b", "forest", "tree", walk("a", "tree", "place", "start"))
    parts.append(f"""done AS (SELECT doc_id, leaf, (SELECT any_value(h) FROM a{levels} t WHERE t.tree = e.tree) AS subroot,
        (SELECT any_value(h) FROM b{levels}) AS root, sha256(proof) AS proof_sha256, claim AS folded_root FROM {end} e)""")
    return f"WITH {', '.join(p.replace(' AS (', ' AS MATERIALIZED (', 1) for p in parts)} SELECT *, folded_root = root AS verified FROM done"


OP13_SQL = _merkle_sql()


def oracle_sql() -> dict[str, str]:
    """Two of these have a SQL form; tests hold the others against brute force, round trips and held-out rows."""
    return {"op12_document_scan": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
