"""Phrase counts that grow with a stream of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from facetloom.operators.ngrams import occurrences


def running_counts(stream: DataFrame, tokens: str = "toks", urls: bool = True) -> DataFrame:
    """(n, ngram, cnt) of everything seen so far; a phrase's row is updated when it is seen again."""
    return occurrences(stream, tokens, (), urls).groupBy("n", "ngram").agg(F.count("*").alias("cnt"))


def windowed_counts(stream: DataFrame, tokens: str = "toks", time: str = "created_at", width: str = "1 hour", late: str = "10 minutes", urls: bool = True) -> DataFrame:
    """(window, n, ngram, cnt) by event time; messages later than the watermark are left out."""
    grams = occurrences(stream.withWatermark(time, late), tokens, (time,), urls)
    return grams.groupBy(F.window(time, width), "n", "ngram").agg(F.count("*").alias("cnt"))


def add_counts(spark: SparkSession, batch: DataFrame, folder: str, epoch: int) -> None:
    """Write a batch's counts beside the earlier ones; a batch that is run twice is written once.

    The batch has rows (n, ngram), and ``times`` where they stand for several.
    """
    times = F.sum("times") if "times" in batch.columns else F.count("*")
    batch.repartition("n", "ngram").groupBy("n", "ngram").agg(times.alias("cnt")).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def stored_counts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).groupBy("n", "ngram").agg(F.sum("cnt").alias("cnt"))


def accumulate(stream: DataFrame, folder: str, checkpoint: str, tokens: str = "toks", urls: bool = True, every: str | None = None) -> StreamingQuery:
    """Counts of each micro-batch as a folder of partial sums; without ``every`` it ends when all is read."""
    grams = occurrences(stream, tokens, (), urls, summed=True)
    write = grams.writeStream.foreachBatch(lambda df, epoch: add_counts(df.sparkSession, df, folder, epoch)).option("checkpointLocation", checkpoint)
    return write.trigger(processingTime=every).start() if every else write.trigger(availableNow=True).start()
