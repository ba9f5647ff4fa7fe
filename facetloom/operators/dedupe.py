"""Exact removal and merging of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.functions.text import norm_urls

#: What makes two messages the same, by name.
KEYS = {
    "text": lambda: F.col("text"),
    "text_url": lambda: norm_urls("text"),
    "text_user": lambda: F.concat_ws("\x1f", "text", "from_user"),
    "text_url_user": lambda: F.concat_ws(":", norm_urls("text"), F.col("from_user")),
}


def first_by(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """The row of each key that comes first in ``order``; kept as an aggregate, so that rows are combined before they are exchanged."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key.alias("__key")).agg(F.max_by(row, order).alias("__row")).select("__row.*")


def hard_dedupe(df: DataFrame, key: str = "text_user") -> DataFrame:
    """One message of each id, then the one with the greatest id of each key."""
    once = first_by(df, F.col("doc_id"), F.struct("text"))
    return first_by(once, KEYS[key](), F.col("doc_id"))


def merge_same_text(df: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each text: the least id and time, all ids, and the other columns (None: all
    of them) as arrays in order of ids; a message that lacks a column has a null there."""
    if columns is None:
        columns = tuple(c for c in df.columns if c not in ("doc_id", "text", "created_at"))
    row = F.struct(F.col("doc_id"), *[F.col(c) for c in columns])
    rows = F.array_sort(F.collect_list(row))
    merged = df.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min("created_at").alias("created_at"), rows.alias("rows"))
    return merged.select(
        "doc_id", "text", "created_at", F.col("rows.doc_id").alias("ids"), *[F.col(f"rows.{c}").alias(f"multi_{c}") for c in columns], (F.size("rows") > 1).alias("multi")
    )


def row_numbers(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows of each group numbered from 1."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
