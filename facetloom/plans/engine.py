"""A search: messages in, ranked topics with groups of near-duplicates out."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.functions import rendering, text
from facetloom.operators import dedupe, topics
from facetloom.operators import language_model as lm
from facetloom.operators.neardup import neardup_groups
from facetloom.operators.ngrams import postings
from facetloom.shared import materialize
from facetloom.sources import messages

TRUE, FALSE = {"1", "t", "true", "y", "yes", "on"}, {"0", "f", "false", "n", "no", "off", ""}


@dataclass(frozen=True)
class QueryOptions:
    q: str = ""
    pages: int = 2
    rpp: int = 100
    max_topics: int = 40
    smoothing: str = "lidstone"
    min_count: int = 3
    english: bool = True
    dedupe_key: str = "text_user"

    def __post_init__(self) -> None:
        if self.smoothing not in lm.SMOOTHING:
            raise ValueError(f"smoothing must be one of {lm.SMOOTHING}")
        if self.dedupe_key not in dedupe.KEYS:
            raise ValueError(f"dedupe_key must be one of {sorted(dedupe.KEYS)}")

    @classmethod
    def from_dict(cls, given: dict) -> QueryOptions:
        """Options from strings; names that are not known are left out."""
        out = {}
        for f in fields(cls):
            if f.name in given:
                v = given[f.name]
                kind = type(f.default)
                if kind is bool and isinstance(v, str):
                    if v.lower() not in TRUE | FALSE:
                        raise ValueError(f"{f.name}: {v!r} is neither true nor false")
                    v = v.lower() in TRUE
                out[f.name] = kind(v)
        return cls(**out)

    @staticmethod
    def topics_for(agent: str) -> int:
        """Fewer topics for phones, known by their user agent."""
        return 10 if re.search("Mobile.*Safari", agent) else 40


@dataclass
class Results:
    docs: DataFrame
    topics: DataFrame
    members: DataFrame
    merged: DataFrame
    shown: DataFrame


def tokens_of(column: str) -> Column:
    """The whole tokenizer's tokens in lower case."""
    return text.lower_tokens(text.tokenize(column))


class Engine:
    """Searches over a table of messages (doc_id, text, created_at, from_user, iso_language_code and any more).

    ``tokens`` is the tokenizer of messages, queries and the background alike; ``urls``:
    whether its tokens may be URLs, which longer phrases must not hold. ``lines``, the
    corpus's (doc_id, iso_language_code, line: tokens with spaces between them), if it is
    there, is what a page is looked up in: only the page's own messages are tokenized then.
    """

    def __init__(self, corpus: DataFrame, background: lm.LanguageModel, tokens: Callable[[str], Column] = tokens_of, urls: bool = True, lines: DataFrame | None = None) -> None:
        self.corpus, self.background, self.tokens, self.urls, self.lines = corpus, background, tokens, urls, lines

    def read(self, o: QueryOptions) -> DataFrame:
        df = messages.english(self.corpus) if o.english else self.corpus
        if self.lines is not None and o.pages is not None:
            said = messages.english(self.lines) if o.english else self.lines
            page = said.where(messages.matches_line(o.q, F.col("line"))).select("doc_id").orderBy(F.desc("doc_id")).limit(o.pages * o.rpp)
            # every message that has one of the page's ids, the same message twice too: the search below decides
            df = df.join(F.broadcast(materialize(page.distinct(), "page")), "doc_id", "left_semi")  # pages * rpp rows at most
        df = messages.search(df, o.q, o.pages, o.rpp, self.tokens)
        merged = dedupe.merge_same_text(dedupe.hard_dedupe(df, o.dedupe_key))
        return materialize(merged.withColumn("toks", self.tokens("text")), "messages")

    def search(self, o: QueryOptions) -> Results:
        docs = self.read(o)
        posts = materialize(postings(docs, urls=self.urls), "postings")
        fg = lm.foreground(docs, urls=self.urls)
        found = materialize(topics.extract_topics(fg, self.background, messages.query_tokens(o.q), o.smoothing, o.min_count), "topics")
        groups = materialize(neardup_groups(docs, posts.where("n = 3").select("doc_id", "ngram")), "groups")
        members = materialize(topics.topic_members(found, posts, groups, docs), "members")
        merged = topics.merge_topics(found, members, docs, fg).where(F.col("rank") < o.max_topics)
        merged = materialize(merged, "merged")
        kept = merged.select("rank", F.explode("ngrams").alias("ngram"), "group_ids")
        shown = kept.join(members, "ngram").where(F.array_contains("group_ids", F.col("group_id")))
        shown = shown.select("rank", "group_id", "doc_id", "created_at").distinct()
        in_topic = merged.select("n", "ngram").join(members, ["n", "ngram"]).select("doc_id")
        left = topics.leftovers(docs, in_topic).join(groups, "doc_id").select(F.lit(-1).alias("rank"), "group_id", "doc_id", "created_at")
        return Results(docs, found, members, merged, materialize(shown.unionByName(left), "shown"))

    def drill_down(self, o: QueryOptions, label: str) -> Results:
        """The search for the query narrowed to a topic's label."""
        return self.search(self.refined(o, label))

    @staticmethod
    def refined(o: QueryOptions, label: str) -> QueryOptions:
        """The options of the query that a topic's label narrows; the query itself for the leftovers."""
        if label == topics.EXTRAS:
            return o
        words = [w for w in label.replace('"', "").replace("/", "").split() if w]
        junk = any(re.match("(?i)^[^a-z0-9@_-]+$", w) for w in words)
        phrase = " ".join(words)
        return replace(o, q=f"{o.q} " + (f'"{phrase}"' if len(words) > 1 and not junk else phrase))

    def rendered(self, r: Results, o: QueryOptions) -> DataFrame:
        """(rank, label, label_grams, group_id, doc_id, created_at, html): every message shown, as HTML with its topic's and the query's phrases marked."""
        grams = F.transform("ngrams", lambda g: F.split(g, " "))
        named = r.shown.join(r.merged.select("rank", "label", grams.alias("label_grams")), "rank", "left")
        named = named.withColumn("label", F.coalesce("label", F.lit(topics.EXTRAS))).withColumn("label_grams", F.coalesce("label_grams", F.array().cast("array<array<string>>")))
        rows = named.join(r.docs.select("doc_id", "text", "toks", "ids", F.col("multi_from_user").alias("users")), "doc_id")
        # tokens are in lower case and have the places of those in the text
        own = rows.withColumn("text", text.squeeze(text.munge_edges(text.squeeze("text")))).withColumn("low", F.lower("text"))
        body = F.when(F.length("low") == F.length("text"), F.col("text")).otherwise(F.col("low"))
        html = F.concat(rendering.message_html("toks", body, messages.query_tokens(o.q), F.col("label_grams"), "low"), F.lit(" &nbsp; "), rendering.authors_html(F.col("users"), F.col("ids")))
        return own.select("rank", "label", "label_grams", "group_id", "doc_id", "created_at", html.alias("html"))

    def to_json(self, r: Results, o: QueryOptions) -> DataFrame:
        """(rank, label, topic): each topic as JSON, its groups newest head first; the leftovers come last, with rank -1."""
        members = F.array_sort(F.collect_list(F.struct("created_at", "doc_id", "html")))
        groups = self.rendered(r, o).groupBy("rank", "label", "group_id").agg(members.alias("m"))
        groups = groups.select("rank", "label", F.struct((-F.unix_seconds(F.col("m")[0]["created_at"])).alias("newest"), F.col("m.doc_id").alias("ids"), F.col("m.html").alias("htmls")).alias("g"))
        per = groups.groupBy("rank", "label").agg(F.array_sort(F.collect_list("g")).alias("gs"))
        topic = F.struct(
            F.col("label"), text.nice_label("label").alias("nice_label"), F.array_join(F.transform(F.flatten("gs.ids"), lambda i: i.cast("string")), " ").alias("tweet_ids"),
            F.transform("gs", lambda g: F.struct(g["htmls"][0].alias("head_html"), F.slice(g["htmls"], F.lit(2), F.size(g["htmls"])).alias("rest_htmls"))).alias("groups"),
            text.query_refinement(o.q, "label").alias("query_refinement"),
        )
        return per.select("rank", "label", F.to_json(topic, {"ignoreNullFields": "false"}).alias("topic"))

    def response(self, r: Results, o: QueryOptions, now: Column) -> DataFrame:
        """One row, the whole answer: topic_list (labels in order), topic_info (by label; of equal labels the last counts)
        and time_since_earliest. It holds ``max_topics`` topics of a page of messages, whatever the corpus."""
        order = F.when(F.col("rank") < 0, F.lit(1 << 30)).otherwise(F.col("rank"))
        rows = F.array_sort(F.collect_list(F.struct(order.alias("order"), "label", "topic")))
        quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
        last = F.filter("rows", lambda x, i: ~F.exists(F.slice("rows", i + 2, F.size("rows")), lambda y: y["label"] == x["label"]))
        info = F.concat(F.lit("{"), F.array_join(F.transform(last, lambda x: F.concat(quoted(x["label"]), F.lit(":"), x["topic"])), ","), F.lit("}"))
        since = r.docs.agg(F.min("created_at").alias("earliest")).select(text.nice_timedelta(F.unix_seconds(now) - F.unix_seconds("earliest")).alias("since"))
        topics_ = self.to_json(r, o).agg(rows.alias("rows"))
        body = F.concat(F.lit('{"topic_list":'), F.to_json(F.col("rows.label")), F.lit(',"topic_info":'), info, F.lit(',"time_since_earliest":'), F.coalesce(quoted(F.col("since")), F.lit("null")), F.lit("}"))
        return topics_.crossJoin(F.broadcast(since)).select(body.alias("response"))  # one row each
