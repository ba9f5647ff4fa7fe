"""HTML of messages and of tables, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.functions.sequences import highlight, index_of, spans_of
from facetloom.functions.text import PEOPLE, escape_html, link_mentions, link_urls
from facetloom.operators.ngrams import SUPER

TOPIC, QUERY, END = '<span class="topic_hl">', '<span class="q_hl">', "</span>"


def highlights(query: list[str], topic: Column) -> Column:
    """Tags for a topic's phrases (arrays of tokens), and for the query's words and pairs that no phrase holds."""
    grams = [query[i : i + 2] for i in range(len(query) - 1)] + [[w] for w in dict.fromkeys(query) if w not in SUPER]
    if not grams:
        return spans_of(topic, TOPIC, END)
    asked = F.array(*[F.array(*map(F.lit, g)) for g in grams])
    open_ = F.filter(asked, lambda g: ~F.exists(topic, lambda t: index_of(g, t) >= 0))
    return F.concat(spans_of(topic, TOPIC, END), spans_of(open_, QUERY, END))


def message_html(tokens: Column | str, text: Column | str, query: list[str], topic: Column | list[list[str]], low: Column | str | None = None) -> Column:
    """A message with the topic's and the query's phrases marked, its URLs and mentions linked.

    ``low`` is the text in which the tokens stand, if not ``text`` itself, character for character.
    """
    if isinstance(topic, list):
        topic = F.array(*[F.array(*map(F.lit, g)) for g in topic]).cast("array<array<string>>")
    return F.concat(F.lit('<span class="text">'), link_mentions(link_urls(highlight(tokens, text, highlights(query, topic), low))), F.lit(END))


def authors_html(users: Column, ids: Column) -> Column:
    """Links to a message at each of its authors; several authors are counted first."""
    links = F.zip_with(users, ids, lambda u, i: F.concat(F.lit(f' <a class="m" target="_blank" href="{PEOPLE}'), u, F.lit("/status/"), i.cast("string"), F.lit('">'), u, F.lit("</a>")))
    count = F.when(F.size(ids) > 1, F.concat(F.size(ids).cast("string"), F.lit(" authors:"))).otherwise("")
    return F.concat(F.lit('<span class="authors">'), count, F.array_join(links, ""), F.lit(END))


def table_html(df: DataFrame) -> DataFrame:
    """A column ``html``: each row as a row of an HTML table, cells escaped."""
    cells = [F.concat(F.lit("<td>"), F.coalesce(escape_html(F.col(c).cast("string")), F.lit("")), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))
