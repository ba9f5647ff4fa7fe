"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes the documents that its predecessor kept and returns those that it keeps,
in the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.llm import decontamination, near_copies, packing, quality, secrets
from facetloom.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the limits and are no outliers of their language and source."""
    return quality.judge(docs.select(*COLUMNS), COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the least doc_id; documents link from a Jaccard similarity of 0.8 of their five-word shingles on, candidates are those of SimHash with pigeonring filtering."""
    return near_copies.firsts(docs.select(*COLUMNS), COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark's items occurs: one leaked item is enough to go."""
    found = decontamination.scan(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.col("found.n_hit") == 0).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and their lengths brought up to date."""
    found = secrets.scan(docs.select(*COLUMNS), mask=True)
    length = F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.pack(docs.select(*COLUMNS), packing.default_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Robust estimates, XXH64 and tokenizers have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
