"""Corpus pipeline: quality filter, exact dedup, near-duplicate removal, mixing, tokenization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.bpe import bpe_encode
from opsloom.llm.common import own_name, ready, table
from opsloom.llm.exact import exact_dedup
from opsloom.llm.mixing import mixed_rows
from opsloom.llm.ngrams import near_components
from opsloom.llm.quality import with_quality
from opsloom.llm.queries import vocabulary
from opsloom.session import fresh_dir

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    score = own_name(docs, "score")
    return with_quality(docs, table(spark, sf_dir, "labels")).where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles of Jaccard 0.8 or more link, that with the smallest doc_id."""
    groups = near_components(docs)
    lost = groups.where("doc_id != component_id").select("doc_id")
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a document stands as often as it is taken."""
    return mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256 and token_ids of every document of the mix."""
    coded = bpe_encode(docs.select("doc_id", "source", "text"), vocabulary(spark), with_ids=True, keep_words=False)
    return coded.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("encode", encode)]

#: SQL can express neither the network nor the merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
