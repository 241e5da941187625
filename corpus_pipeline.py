"""From raw documents to packed sequences, in five stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glasswork.llm import decontamination, importance, near_duplicates, packing, secrets
from glasswork.llm.inputs import written
from glasswork.llm.queries import TOKENIZER_WORDS, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.keep_sampled(docs, importance.fit(docs, labels))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def scrub(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; ``n_chars`` follows the text."""
    before = F.col("n_chars") - F.coalesce(F.length("text"), F.lit(0))
    out = secrets.redact(docs.withColumn("n_chars", before))
    after = (F.col("n_chars") + F.coalesce(F.length("text"), F.lit(0))).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", after)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, windows mixed by source."""
    pieces = packing.pack(docs, tokenizer_path(TOKENIZER_WORDS), end_id=1)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("secrets", scrub), ("packing", pack),
]

# Gumbel keys, min-hash classes and BPE ids have no SQL form; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
