"""A corpus pipeline over the documents table: each stage works on what its predecessor kept.

Quality rules drop what the current policy rejects; the n-gram Jaccard join keeps one document of each group of near
duplicates (five-word n-grams, similarity 0.8); decontamination drops documents that contain benchmark items; the
secret scan replaces live-looking credentials in the texts; packing lays the tokens into sequences.

Decisions of a stage use no other table than its input and, for decontamination, ``benchmark``. All stages but the last
return the columns of ``documents``; a redacted text has its ``n_chars`` counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard_join, packing, quality_rules, secret_scan
from plumbline.llm.queries import public_tokenizer
from plumbline.llm.rowkeys import prepare, table
from plumbline.scale import materialise

POLICY = "v2"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules.passing(docs, POLICY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard_join.one_of_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, public_tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", packed),
]

#: Token ids and their packing are not SQL; the tests hold ``run`` against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
