"""Secret scans through a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: every match holds the
trigrams of one of the pattern's literal strings. Texts are indexed in segments (a block of
texts each): trigram -> the texts that have it, ASCII letters folded. A rule's query
intersects and unites postings, and its pattern is run over the texts that remain. A rule
whose pattern has no mandatory trigram is run over all texts.

Segments are made and searched where the texts are, without a shuffle; a segment of
``SEGMENT`` bytes posts the trigrams that some rule's query names, over whole texts.

Defined cases: a null text is empty; an empty text has no spans; rows that repeat get a row
each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom.llm.common import blocks, code_points, map_arrow, table, utf8
from facetloom.llm.spans import digests

#: Literal strings that a part of a pattern may stand for before its trigrams are taken.
STRINGS = 64
#: Bytes of texts in a segment; a longer text is one of its own.
SEGMENT = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A match counts if ``group`` of it has ``least`` characters at least."""

    kind: str
    pattern: bytes
    least: int = 0
    group: int = 0


RULES = [
    Rule("assign", rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", rb"AKIA[A-Z0-9]+", 16),
    Rule("hex", rb"[0-9a-f]{32,}"),  # the runs [0-9a-f]+ of 32 or more
    Rule("private_key", rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", rb"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", rb"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
N_BASE = 3

#: A query is True (all texts), a trigram, or ("and" | "or", queries).
Query = object


def _join(op: str, parts: list[Query]) -> Query:
    neutral = op == "and"
    if any(p is True for p in parts) and not neutral:
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _any_of(strings: set[bytes]) -> Query:
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(node: tuple) -> set[bytes] | None:
    """The strings, letters folded, that a node of a parsed pattern stands for, if they are few."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {bytes([arg]).lower()}
    if op == "IN":
        out = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.add(bytes([value]).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 16:
                out |= {bytes([b]).lower() for b in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 16 else None
    if op == "AT":
        return {b""}
    if op == "SUBPATTERN":
        return _product(arg[-1])
    if op == "BRANCH":
        sides = [_product(x) for x in arg[1]]
        return None if any(s is None for s in sides) else set().union(*sides)
    if op.endswith("_REPEAT"):
        low, high, inner = arg
        once = _product(inner) if int(high) <= 3 else None
        if once is None or len(once) ** int(high) > STRINGS:
            return None
        powers = [{b""}]
        for _ in range(int(high)):
            powers.append({a + b for a in powers[-1] for b in once})
        return set().union(*powers[int(low) :])
    return None


def _product(seq) -> set[bytes] | None:
    out = {b""}
    for node in seq:
        one = _strings(node)
        if one is None or len(one) * len(out) > STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def _query(seq) -> Query:
    parts, held = [], {b""}
    for node in seq:
        one = _strings(node)
        if one is not None and len(one) * len(held) <= STRINGS:
            held = {a + b for a in held for b in one}
            continue
        parts.append(_any_of(held))
        held, op, arg = {b""}, str(node[0]), node[1]
        if one is not None:
            held = one
        elif op == "SUBPATTERN":
            parts.append(_query(arg[-1]))
        elif op == "BRANCH":
            parts.append(_join("or", [_query(x) for x in arg[1]]))
        elif op.endswith("_REPEAT") and int(arg[0]) > 0:
            parts.append(_query(arg[2]))
    return _join("and", [*parts, _any_of(held)])


def trigram_query(pattern: bytes) -> Query:
    """A Boolean trigram query that holds for every text in which the pattern matches."""
    from re import _parser

    return _query(_parser.parse(pattern))


def trigrams_of(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set().union(*map(trigrams_of, query[1])) if isinstance(query, tuple) else set()


def _short(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Trigrams as 16 bits, with which most places are ruled out."""
    return (a.astype(np.uint16) << np.uint16(8)) + b.astype(np.uint16) * np.uint16(37) + c


class Segment:
    """Postings of a block of texts for the given trigrams, which are in order."""

    def __init__(self, texts: list[bytes], trigrams: list[bytes], codes: np.ndarray, short: np.ndarray) -> None:
        self.n = len(texts)
        starts = np.cumsum([0, *[len(t) + 2 for t in texts[:-1]]])
        self.postings = {t: np.empty(0, dtype=np.int64) for t in trigrams}
        joined = np.frombuffer(b"\x00\x00".join(texts).lower(), dtype=np.uint8)
        pairs = []
        for a in range(0, len(joined) - 2, SEGMENT):  # a long text in parts
            data = joined[a : a + SEGMENT + 2]
            at = np.flatnonzero(short[_short(data[:-2], data[1:-1], data[2:])])
            code = data[at].astype(np.int64) << 16 | data[at + 1].astype(np.int64) << 8 | data[at + 2]
            which = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            found = codes[which] == code
            pairs.append(np.unique(which[found] * self.n + np.searchsorted(starts, a + at[found], side="right") - 1))
        if not pairs:
            return
        pairs = np.unique(np.concatenate(pairs))
        which, text = pairs // self.n, pairs % self.n
        edges = np.searchsorted(which, np.arange(len(trigrams) + 1))
        for k, t in enumerate(trigrams):
            self.postings[t] = text[edges[k] : edges[k + 1]]

    def search(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        op = np.intersect1d if query[0] == "and" else np.union1d
        return reduce(op, map(self.search, query[1]))


class Index:
    """The rules' queries, and the segments made for them."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = [(i, r, re.compile(r.pattern), trigram_query(r.pattern)) for i, r in enumerate(rules)]
        self.trigrams = sorted(set().union(*(trigrams_of(q) for *_, q in self.rules)))
        letters = np.asarray([list(t) for t in self.trigrams], dtype=np.uint8).reshape(-1, 3)
        self.codes = letters.astype(np.int64) @ np.asarray([1 << 16, 1 << 8, 1])
        self.short = np.zeros(1 << 16, dtype=bool)
        self.short[_short(*letters.T)] = True

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rank, end) in bytes of every text's spans."""
        segment = Segment(texts, self.trigrams, self.codes, self.short)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for rank, rule, regex, query in self.rules:
            for i in segment.search(query).tolist():
                for m in regex.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), rank, m.end()))
        return out


_SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "rank", "end")]))
_ARROW = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "rank", "end")]))
MASK = b"[SECRET]"


def masked(text: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    """The text with every run of overlapping spans replaced."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return b"".join([*out, text[at:]])


def scan(docs: DataFrame, rules: list[Rule] = RULES, mask: bool = False) -> DataFrame:
    """``docs`` (with a column text) and ``secrets``: an array of start, rank (place in
    ``rules``) and end in code points, exclusive. ``mask`` replaces them in text. A column
    of ``docs`` that is named ``secrets`` gives way."""
    docs = docs.drop("secrets")
    schema = T.StructType([*docs.schema.fields, T.StructField("secrets", _SPANS)])
    text_at = docs.columns.index("text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        for batch in batches:
            given = utf8(batch.column(text_at))
            texts = [t or b"" for t in given]
            found: list = []
            for a, b in blocks([len(t) for t in texts], SEGMENT):
                found += index.scan(texts[a:b])
            out = []
            for i, spans in enumerate(found):
                flat = code_points(texts[i], np.asarray([(s, e) for s, _, e in spans], dtype=np.int64).ravel())
                out.append([{"start": int(s), "rank": k, "end": int(e)} for (_, k, _), s, e in zip(spans, flat[::2], flat[1::2], strict=True)])
                if mask and spans:
                    given[i] = masked(texts[i], spans)
            columns = list(batch.columns)
            if mask:
                columns[text_at] = pa.array(given, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, _ARROW)], names=[*batch.schema.names, "secrets"])

    return map_arrow(docs, search, schema)


def op6_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    return found.select("doc_id", *digests(F.col("secrets"), [r.kind for r in RULES], N_BASE))
