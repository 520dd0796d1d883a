"""Documents to token ids in five stages, each an operator of anamnesis.llm.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm.common import settle_alone, table
from anamnesis.llm.mixing import mix_documents
from anamnesis.llm.pieces import default_model_file, encode_documents
from anamnesis.llm.pii import redact_documents
from anamnesis.llm.quality import kept_documents
from anamnesis.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the least id."""
    return keep_one(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind in brackets."""
    return redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at rates that bring the domains to their target weights."""
    return mix_documents(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their count and digests."""
    return encode_documents(docs, default_model_file())


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", mask_pii),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]
#: Fingerprints, random fields and merges are not for SQL; the tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each settled before the next and its
    intermediate tables deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle_alone(spark, partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
