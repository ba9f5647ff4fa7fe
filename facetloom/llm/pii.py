"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust scores.

All of it is DataFrame expressions. ``split`` and ``regexp_extract_all`` find the same
matches, so the lengths of the gaps and matches give offsets in code points without any
position function. The patterns are written so that they start only where a run starts and
never back-track into it, which keeps long runs linear and the regex engine's stack flat;
they find exactly the leftmost matches of the plain forms beside them:

  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
  ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)     each part at most 255
  card   [0-9]([\\x20-]?[0-9])+                      14 to 19 digits that pass Luhn
  phone  \\+[0-9][\\x20().0-9-]+[0-9]                10 to 15 digits

Two more kinds are proposed: iban (confirmed by mod-97) and ssn (no checksum, so only the
words before it can raise its score to the threshold). Spans of the four kinds above are
kept whatever their score.

Defined cases: a null text is empty; an empty text has no spans; rows that repeat get a row
each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.llm.common import table
from facetloom.llm.spans import digests

#: Code points before a span in which context words count.
CONTEXT = 40
CONTEXT_SCORE = 0.3
THRESHOLD = 0.6


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(d, n - i + 1, 1).cast("int")
        return total + F.when(i % 2 == 1, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(m: Column) -> Column:
    s = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        a = F.ascii(c)
        return F.when(a < 58, (rest * 10 + a - 48) % 97).otherwise((rest * 100 + a - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: a character without which there is no match
    needs: str
    valid: object
    score: float
    words: str
    base: bool = True


KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9, "e-?mail|mail|contact"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", lambda m: F.rlike(m, F.lit(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")), 0.7, r"\bip\b|addr|host|server"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])", "", luhn, 0.8, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", lambda m: F.length(_digits(m)).between(10, 15), 0.7, "phone|tel|call|mobile"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", mod97, 0.8, "iban|account|bank|konto", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", lambda m: ~F.rlike(m, F.lit("^(?:000|666|9)|-00-|-0000$")), 0.4, r"\bssn\b|social security|tax id", base=False),
]
NAMES = [k.name for k in KINDS]
N_BASE = sum(k.base for k in KINDS)

_FOUND = "struct<at:int,spans:array<struct<start:int,rank:int,end:int,score:double>>>"


def _spans(rank: int, kind: Kind, text: Column, matches: Column) -> Column:
    """Spans of the valid matches of a kind with their scores."""
    gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(matches))
    pairs = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        near = F.lower(F.substring(x["g"], -CONTEXT, CONTEXT))
        score = F.lit(kind.score) + F.when(F.rlike(near, F.lit(kind.words)), F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0))
        ok = kind.valid(x["m"]) if kind.base else kind.valid(x["m"]) & (score >= THRESHOLD)
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score")))
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans")).cast(_FOUND)

    none = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(_FOUND)
    return F.when(F.size(matches) > 0, F.aggregate(pairs, none, add)["spans"]).otherwise(none["spans"])


def find(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column text) and ``pii``: an array of start, rank (place in
    ``NAMES``), end (code points, exclusive) and score."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.columns
    none = F.array().cast("array<string>")
    matches = [
        F.when(F.contains(text, F.lit(k.needs)) if k.needs else F.lit(True), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"__m_{k.name}")
        for k in KINDS
    ]
    found = docs.select(*own, *matches)
    spans = F.concat(*[_spans(i, k, text, F.col(f"__m_{k.name}")) for i, k in enumerate(KINDS)])
    return found.select(*own, spans.alias("pii"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    return found.select("doc_id", *digests(F.col("pii"), NAMES, N_BASE))
