"""The corpus pipeline: quality rules, n-gram Jaccard join, secret scans, mixing to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last give the columns of documents.

Edge cases: a null text counts as empty, which the quality rules reject, as they do blank and short texts; texts of any
length are worked on whole; of repeated rows, and of rows tied for a class's least id, one stays; null ids, languages and
sources are values of their own; extra columns are kept up to the last stage, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringspan.llm import bpe, jaccard_join, mixing, quality_rules, secrets
from ringspan.llm.common import fresh


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secrets.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target shares of source, language and topic."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document: count, digest of the ids, digest of their decoding."""
    return bpe.round_trip(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan), ("mixing", mix), ("BPE", tokens)]
#: Grammars, the LSH forest and BPE have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := fresh(spark, f"stage-{name.replace(' ', '-')}"))
        docs = spark.read.parquet(path)
    return docs
