"""Functions on arrays of tokens, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(t: Column, n: Column | int) -> Column:
    """Places, from 1, where a run of ``n`` may begin."""
    return F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))


def ngrams(tokens: Column | str, n: int, keep: Callable[[list[Column]], Column] | None = None, word: Callable[[Column], Column] = lambda t: t) -> Column:
    """Runs of ``n`` neighbouring tokens, joined by a space, in order; ``keep`` filters them by their tokens, ``word`` is a token's text."""

    def of(t: Column) -> Column:
        parts = lambda i: [F.element_at(t, i + k) for k in range(n)]
        starts = _starts(t, n)
        if keep is not None:
            starts = F.filter(starts, lambda i: keep(parts(i)))
        return F.transform(starts, lambda i: F.concat_ws(" ", *map(word, parts(i))))

    return let(_col(tokens), of)


def index_of(sub: Column | str, tokens: Column | str) -> Column:
    """The first place (from 0) where one array occurs inside another; -1 if nowhere."""
    s = _col(sub)

    def of(t: Column) -> Column:
        found = F.filter(_starts(t, F.size(s)), lambda i: F.slice(t, i, F.size(s)) == s)
        return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(0)) - 1

    return let(_col(tokens), of)


def align(tokens: Column | str, text: Column | str) -> Column:
    """Each token's offset in the text, searched onwards from the end of the one before."""
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))

    def of(s: Column) -> Column:
        def step(acc: Column, tok: Column) -> Column:
            place = F.call_function("locate", tok, s, acc["at"])
            return F.struct((place + F.length(tok)).alias("at"), F.concat(acc["out"], F.array(place - 1)).alias("out"))

        return F.aggregate(_col(tokens), zero, step)["out"]

    return let(_col(text), of)


def jaccard(a: Column | str, b: Column | str) -> Column:
    x, y = _col(a), _col(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def dice(a: Column | str, b: Column | str) -> Column:
    x, y = _col(a), _col(b)
    return 2 * F.size(F.array_intersect(x, y)) / (F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)))


def spans_of(grams: Column, start: str, end: str) -> Column:
    """n-grams (arrays of tokens) with the tags that ``highlight`` is to put around them."""
    return F.transform(grams, lambda g: F.struct(g.alias("gram"), F.lit(start).alias("start"), F.lit(end).alias("end")))


def highlight(tokens: Column | str, text: Column | str, spans: Column | list[tuple[list[str], str, str]], low: Column | str | None = None) -> Column:
    """The text with tags around every occurrence of each n-gram (structs gram, start, end); longer n-grams are outermost.

    All tags are put in order of their places once, and the text is cut there. ``low`` is
    where the tokens are looked for, if not in the text itself.
    """
    if isinstance(spans, list):
        if not spans:
            return _col(text)
        spans = F.array(*[F.struct(F.array(*map(F.lit, g)).alias("gram"), F.lit(a).alias("start"), F.lit(b).alias("end")) for g, a, b in spans])
    ordered = F.array_sort(spans, lambda a, b: F.size(b["gram"]) - F.size(a["gram"]))

    def edges(t: Column, at: Column, span: Column, k: Column) -> Column:
        """The tags (place, rank among the tags of a place, tag) of an n-gram's occurrences."""
        n = F.size(span["gram"])
        places = F.filter(_starts(t, n), lambda i: F.slice(t, i, n) == span["gram"])
        tag = lambda place, rank, mark: F.struct(place.cast("int").alias("at"), rank.alias("rank"), mark.alias("tag"))
        begins = F.transform(places, lambda i: tag(F.element_at(at, i), 2 * k + 1, span["start"]))
        return F.concat(begins, F.transform(places, lambda i: tag(F.element_at(at, i + n - 1) + F.length(F.element_at(t, i + n - 1)), 2 * k, span["end"])))

    def bound(y: Column) -> Column:
        return F.struct(y["s"].alias("s"), F.array_sort(F.flatten(F.transform(y["spans"], lambda x, k: edges(y["t"], y["at"], x, k)))).alias("tags"))

    def of(x: Column) -> Column:
        def piece(e: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(x["tags"], i - 1)["at"]).otherwise(0)
            return F.concat(F.substr(x["s"], before + 1, e["at"] - before), e["tag"])

        last = F.coalesce(F.try_element_at(x["tags"], F.lit(-1))["at"], F.lit(0))
        return F.concat(F.array_join(F.transform(x["tags"], piece), ""), F.substr(x["s"], last + 1))

    t, s = _col(tokens), _col(text)
    return let(let(F.struct(t.alias("t"), s.alias("s"), align(t, s if low is None else low).alias("at"), ordered.alias("spans")), bound), of)
