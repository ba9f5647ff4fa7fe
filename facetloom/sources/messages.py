"""Where messages come from and go to: JSON lines, delimited text, plain lines, Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom.functions.sequences import index_of
from facetloom.functions.text import quoted_if_phrase, simple_tokens

MESSAGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("from_user", T.StringType()),
        T.StructField("from_user_id", T.LongType()),
        T.StructField("to_user", T.StringType()),
        T.StructField("to_user_id", T.LongType()),
        T.StructField("iso_language_code", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("profile_image_url", T.StringType()),
    ]
)


def parse_time(c: Column | str) -> Column:
    """``Sun, 19 Apr 2009 05:38:24 +0000`` as a timestamp."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(F.substr(c, F.lit(6)), F.lit("dd MMM yyyy HH:mm:ss Z"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Messages from JSON lines; keys that a line lacks are null."""
    return spark.read.schema(MESSAGE).json(path).withColumnRenamed("id", "doc_id").withColumn("created_at", parse_time("created_at"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated values; quotes mean nothing."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def tsv_rows(df: DataFrame) -> DataFrame:
    """(doc_id, created_at, from_user, text) fit for tab-separated lines, one row an id."""
    flat = F.regexp_replace("text", r"[\r\n\t]", " ")
    rows = df.select("doc_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "from_user", flat.alias("text"))
    return rows.dropDuplicates(["doc_id"])


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated values with a header, columns in order of their names."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("header", True).csv(path)


def save_results(df: DataFrame, path: str) -> None:
    """A search's messages, to be read again instead of searching."""
    df.write.mode("overwrite").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One message a line, for background corpora."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents as messages; an id is also a time, in seconds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "text", F.timestamp_seconds(F.col("doc_id") + 1240000000).alias("created_at"), F.col("source").alias("from_user"), F.col("lang").alias("iso_language_code"))


def from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table conversations as messages: short texts, all taken as English."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    return turns.select("doc_id", "text", F.timestamp_seconds(F.col("doc_id") + 1240000000).alias("created_at"), F.col("role").alias("from_user"), F.lit("en").alias("iso_language_code"))


def english(df: DataFrame) -> DataFrame:
    return df.where(F.col("iso_language_code") == "en")


def parse_query(query: str) -> list[list[str]]:
    """A query's terms as token lists: words, and phrases in double quotes."""
    terms = []
    for i, part in enumerate(query.split('"')):
        words = part.lower().split()
        terms += [words] if i % 2 and words else [[w] for w in words]
    return terms


def query_tokens(query: str) -> list[str]:
    """All words of a query, in order, without the ``OR`` between its parts."""
    return [w for part in query.split(" OR ") for term in parse_query(part) for w in term]


def matches(query: str, tokens: Column, text: Column | None = None) -> Column:
    """Whether tokens hold every word and phrase of a query; ``OR`` between parts means any of
    them. ``text``, what the tokens were made of, rules most messages out without tokens."""

    def all_of(part: str) -> Column:
        out = F.lit(True)
        for w in {w for term in parse_query(part) for w in term if w.isascii()} if text is not None else ():
            out = out & F.contains(F.lower(text), F.lit(w))
        for term in parse_query(part):
            found = F.array_contains(tokens, term[0]) if len(term) == 1 else index_of(F.array(*[F.lit(w) for w in term]), tokens) >= 0
            out = out & found
        return out

    out = F.lit(False)
    for part in query.split(" OR "):
        out = out | all_of(part)
    return out


def matches_line(query: str, line: Column) -> Column:
    """``matches`` of tokens that are joined by spaces."""
    within = F.concat(F.lit(" "), line, F.lit(" "))
    out = F.lit(False)
    for part in query.split(" OR "):
        found = F.lit(True)
        for term in parse_query(part):
            found = found & F.contains(within, F.lit(f" {' '.join(term)} "))
        out = out | found
    return out


def search(df: DataFrame, query: str, pages: int | None = 2, rpp: int = 100, tokens: Callable[[str], Column] = simple_tokens) -> DataFrame:
    """Messages that match, newest ids first: ``pages`` pages of ``rpp`` (None: all)."""
    found = df.where(matches(query, tokens("text"), F.col("text")))
    return found if pages is None else found.orderBy(F.desc("doc_id")).limit(pages * rpp)


def scrape(fetch: Callable[[str, int], DataFrame | None], until: str, pages: int = 15, failures: int = 3) -> Iterator[DataFrame]:
    """Pages of messages, sliding the end date back; stops after too many empty pages in a row."""
    from datetime import date, timedelta

    empty, end = 0, date.fromisoformat(until)
    while empty <= failures:
        oldest = None
        for page in range(1, pages + 1):
            got = fetch(end.isoformat(), page)
            low = got.agg(F.min("created_at")).first()[0] if got is not None else None
            if low is None:
                empty += 1
                break
            empty, oldest = 0, low.date()
            yield got
        end = (oldest or end) - timedelta(days=1)


def read_pages(spark: SparkSession, fetch: Callable[[str, int, int], list[str] | None], query: str, pages: int = 2, rpp: int = 100, retries: int = 1) -> DataFrame:
    """Messages of a paged endpoint, a task for each page, newest ids first.

    ``fetch(query, page, rpp)`` returns a page's messages as JSON strings, or None for one
    that is not there; it is tried ``retries`` times more if it raises ``OSError``, and the
    page is empty then. Other errors fail the task, which Spark runs again.
    """
    asked = spark.createDataFrame([(p,) for p in range(1, pages + 1)], "page int").repartition(pages, "page")

    def read(frames):
        import pandas as pd

        for frame in frames:
            for page in frame["page"]:
                got = None
                for _ in range(retries + 1):
                    try:
                        got = fetch(query, int(page), rpp)
                        break
                    except OSError:
                        continue
                yield pd.DataFrame({"line": got or []}, dtype="string")

    rows = asked.mapInPandas(read, "line string").select(F.from_json("line", MESSAGE).alias("m")).select("m.*")
    return rows.withColumnRenamed("id", "doc_id").withColumn("created_at", parse_time("created_at")).orderBy(F.desc("doc_id"))


class Trends:
    """Trending topics, asked for again when they are older than ``stale`` seconds; a failing
    source is tried ``retries`` times, and keeps the last answer then."""

    def __init__(self, spark: SparkSession, fetch: Callable[[], list[str]], stale: int = 300, retries: int = 5) -> None:
        self.spark, self.fetch, self.stale, self.retries = spark, fetch, stale, retries
        self.at: float | None = None
        self.names: list[str] = []

    def needs_update(self, now: float) -> bool:
        return self.at is None or now - self.at > self.stale

    def current(self, now: float) -> DataFrame:
        if self.needs_update(now):
            for _ in range(self.retries):
                try:
                    self.names, self.at = self.fetch(), now
                    break
                except OSError:
                    continue
        return with_simple_query(self.spark.createDataFrame([(n,) for n in self.names], "name string"))


def featurize_tsv(spark: SparkSession, source: str, target: str, columns: int) -> None:
    """Tab-separated lines with the text in the last of ``columns`` columns, which is replaced by its features."""
    from facetloom.functions.text import tokenize
    from facetloom.operators.ngrams import feature_line

    names = [f"c{i}" for i in range(columns)]
    rows = read_tsv(spark, source, ", ".join(f"{c} string" for c in names))
    write_tsv(rows.withColumn(names[-1], feature_line(tokenize(F.coalesce(names[-1], F.lit(""))))), target)


def with_simple_query(trends: DataFrame) -> DataFrame:
    return trends.withColumn("simple_query", quoted_if_phrase("name"))
