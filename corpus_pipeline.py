"""The corpus pipeline: documents through five operators of ``folionaut.llm``, each stage written and read again.

Quality drops what the classifier rejects; near duplicates leave one document of each group; benchmark passages are cut
out, and documents that are mostly such passages dropped; secrets are replaced by a mark; what is left is packed into
token sequences. Each stage works on all rows of the one before. Columns other than ``text`` and ``n_chars`` pass as
they are, and an empty table gives an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folionaut.llm import decontaminate, jaccard, packing, quality, secrets
from folionaut.llm.session import prepare, staged

#: Near duplicates of the pipeline: word shingles and the least similarity in percent.
SHINGLE_WORDS = 5
SIMILARITY = 80
END_ID = 2


def _lengths(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality.accepted(docs, quality.learned(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.representatives(docs, SHINGLE_WORDS, SIMILARITY)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _lengths(decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = secrets.train(secrets.samples(secrets.with_base_spans(docs.select("text"))))
    return _lengths(secrets.redacted(docs, model))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), spaced=False, end_id=END_ID)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sequence_packing", sequence_packing),
]

# Tokenizers and fitted models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
