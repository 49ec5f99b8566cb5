"""From raw documents to token ids: each stage applies one operator to all that the stage before kept.

quality      documents that the rule ensemble rejects go
near_copies  one document of each group of near copies stays: those with a Jaccard index of 0.8 or more of their five-word shingles
benchmark    documents that hold a window of a benchmark item go
secrets      secrets in the texts are masked
tokens       doc_id, number of tokens and token ids of each text
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import bpe, decontaminate, ngram_join, quality, secrets
from assay.llm.common import materialize, table
from assay.llm.queries import WORD_BPE


#: Near copies: words of a shingle, and the least Jaccard index in hundredths. op9_ngram_join has figures of its own.
SHINGLE, NEAR = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, SHINGLE, NEAR)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs)
    if "n_chars" in masked.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_ids(docs, WORD_BPE).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("secrets", mask_secrets),
    ("tokens", encode),
]

#: The classifier is fitted and the encoder follows a merge list; neither has an SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
