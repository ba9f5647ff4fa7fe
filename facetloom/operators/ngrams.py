"""Filtered n-grams of messages and their postings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom.functions import text
from facetloom.functions.sequences import let, ngrams
from facetloom.shared import map_array, materialize, new_path, passing, write_array

# The stop word lists.
SUPER = "and of a an the in to & @".split()
NORMAL = (
    "about all am as at be but by do don't for from got had hadn't has have having he how i i'll i'm in is it it's "
    "just like me my na no not on or she so that them they this was what when where which who why with"
).split()
ONLY_AS_UNIGRAMS = "her his if its up you".split()
LEFTSIDE = ") ] }".split()
RIGHTSIDE = "i ( [ {".split()


#: What is to be known of a token, worked out once wherever it occurs, as bits.
STOP, TOO_COMMON, LEFT, RIGHT, EDGE, BOUNDARY, JUNK, HASH, AT, LINK = (1 << i for i in range(10))


def _plain(t: Column) -> Column:
    """Whether a token begins with a letter, a digit or ``_`` of ASCII: then it is no punctuation."""
    c = F.ascii(t)
    return c.between(97, 122) | c.between(48, 57) | c.between(65, 90) | (c == 95)


def flagged(tokens: Column, urls: bool = True) -> Column:
    """Tokens as structs of the token ``t`` and its bits ``f``; ``urls``: tokens may be URLs."""
    bit = lambda test, value: F.when(test, value).otherwise(0)

    def of(t: Column) -> Column:
        odd = bit(F.rlike(t, F.lit(text.EDGE_TOKEN)), EDGE) + bit(F.rlike(t, F.lit(text.PHRASE_BOUNDARY)), BOUNDARY) + bit(F.rlike(t, F.lit(text.JUNK)), JUNK)
        odd = odd + bit(F.startswith(t, F.lit("#")), HASH) + bit(F.startswith(t, F.lit("@")), AT)
        bits = F.when(_plain(t), F.lit(0)).otherwise(odd)
        for words, value in ((SUPER + NORMAL + ONLY_AS_UNIGRAMS + LEFTSIDE + RIGHTSIDE, STOP), (SUPER, TOO_COMMON), (LEFTSIDE, LEFT), (RIGHTSIDE, RIGHT)):
            bits = bits + bit(t.isin(words), value)
        if urls:
            bits = bits + bit(text.has_url(t), LINK)
        return F.struct(t.alias("t"), bits.alias("f"))

    return F.transform(tokens, of)


def _any(p: list[Column], bits: int) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [x["f"] for x in p]).bitwiseAND(F.lit(bits)) != 0


def keep_unigram(p: list[Column]) -> Column:
    return ~_any(p, STOP | BOUNDARY | EDGE)


def _mentions(p: list[Column]) -> Column:
    return sum(x["f"].bitwiseAND(F.lit(AT)) for x in p) <= AT


def keep_bigram(p: list[Column]) -> Column:
    """Neither word too common or punctuation, no hashtag and no URL, one mention at most."""
    return ~_any(p, TOO_COMMON | EDGE | BOUNDARY | JUNK | HASH | LINK) & _mentions(p)


def keep_trigram(p: list[Column]) -> Column:
    """As for two words, but the one in the middle may be a common word or junk."""
    ends = ~_any(p[:1], TOO_COMMON | LEFT | JUNK) & ~_any(p[-1:], TOO_COMMON | RIGHT | JUNK)
    return ends & ~_any(p, BOUNDARY | HASH | LINK) & _mentions(p)


KEEP = {1: keep_unigram, 2: keep_bigram, 3: keep_trigram}


def drop_leading_mentions(tokens: Column) -> Column:
    """Tokens from the first that is no mention."""
    return _from_first(tokens, lambda t: ~F.startswith(t, F.lit("@")))


def _from_first(items: Column, test) -> Column:
    first = F.array_position(F.transform(items, test), F.lit(True))
    return F.slice(items, F.when(first == 0, F.size(items) + 1).otherwise(F.greatest(first, F.lit(1))).cast("int"), F.size(items))


def _grams(x: Column, n: int) -> Column:
    """The n-grams of flagged tokens that pass the filters for their length."""
    rest = x if n == 1 else _from_first(x, lambda t: t["f"].bitwiseAND(F.lit(AT)) == 0)
    return ngrams(rest, n, KEEP[n], lambda t: t["t"])


def filtered(tokens: Column | str, n: int, urls: bool = True) -> Column:
    """The n-grams of tokens that pass the filters for their length; ``urls``: tokens may be URLs."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return let(flagged(t, urls), lambda x: _grams(x, n))


#: Tokens that a worker counts at once; a longer message is one block.
BLOCK_TOKENS = 1 << 20
#: Bytes of text that count as one token where a block is cut.
TOKEN_BYTES = 6
#: The ends of lines that ``$`` of the filters' patterns stands before.
_END = r"(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z"


#: The bits of the words in lists, and the patterns for what begins with no letter or digit of ASCII.
_WORDS: dict[str, int] = {}
for _list, _bit in ((SUPER + NORMAL + ONLY_AS_UNIGRAMS + LEFTSIDE + RIGHTSIDE, STOP), (SUPER, TOO_COMMON), (LEFTSIDE, LEFT), (RIGHTSIDE, RIGHT)):
    _WORDS |= {w: _WORDS.get(w, 0) | _bit for w in _list}
_ODD = [(re.compile(p.removesuffix("$") + _END).match, v) for p, v in ((text.EDGE_TOKEN, EDGE), (text.PHRASE_BOUNDARY, BOUNDARY), (text.JUNK, JUNK))]


def word_bits(words: pa.Array, links: frozenset[str] = frozenset()) -> np.ndarray:
    """The bits that ``flagged`` finds for each of some words; ``links`` are those that hold a URL."""
    listed = pc.index_in(words, pa.array(list(_WORDS))).fill_null(len(_WORDS)).to_numpy()
    bits = np.asarray([*_WORDS.values(), 0], dtype=np.int64)[listed]
    odd = np.flatnonzero(~pc.match_substring_regex(words, "^[A-Za-z0-9_]").to_numpy(zero_copy_only=False))
    for i, w in zip(odd.tolist(), words.take(pa.array(odd)).to_pylist(), strict=True):
        bits[i] |= sum(v for pattern, v in _ODD if pattern(w)) | (HASH if w.startswith("#") else AT if w.startswith("@") else 0)
    if links:
        bits[pc.is_in(words, pa.array(list(links))).to_numpy(zero_copy_only=False)] |= LINK
    return bits


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Which bytes simple tokens (``text.SIMPLE``) are made of; all bytes of other characters are none.
_SIMPLE = np.zeros(256, dtype=bool)
_SIMPLE[list(b"abcdefghijklmnopqrstuvwxyz0123456789_@#'")] = True
_NO_SPACE = np.arange(256) != 32


def _strings(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, and where each begins and ends there; null is empty."""
    if values.null_count:
        values = pc.fill_null(values, "")
    wide = np.dtype(np.int64 if pa.types.is_large_string(values.type) else np.int32)
    if not len(values):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=wide)
    _, ends, letters = values.buffers()
    ends = np.frombuffer(ends, dtype=wide, count=len(values) + 1, offset=values.offset * wide.itemsize)
    letters = np.frombuffer(letters, dtype=np.uint8) if letters else np.empty(0, dtype=np.uint8)
    return letters[ends[0] : ends[-1]], ends - ends[0]


def split_simple(low: pa.Array) -> pa.Array:
    """The simple tokens of texts that are in lower case, as ``text.simple_tokens`` finds them."""
    return _split(low, _SIMPLE)


def split_lines(lines: pa.Array) -> pa.Array:
    """The tokens of lines, which are between spaces."""
    return _split(lines, _NO_SPACE)


def _split(texts: pa.Array, kind: np.ndarray) -> pa.Array:
    letters, ends = _strings(texts)
    inside = kind[letters]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    rows = ends[:-1][ends[:-1] < len(letters)]
    begins[rows] = inside[rows]
    at, places = np.flatnonzero(begins), np.flatnonzero(begins[inside])
    said = letters[inside]
    words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(places, len(said)).astype(np.int32)), pa.py_buffer(said)])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, ends).astype(np.int32)), words)


def _is_text(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_large_string(kind)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Different values, in order."""
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


class Block:
    """The tokens of some messages, numbered by their words, and where their n-grams begin.

    Messages are arrays of tokens or strings: texts in lower case, whose simple tokens are found here,
    or (``lines``) tokens with spaces between them.
    """

    def __init__(self, tokens: pa.Array, links: frozenset[str], lines: bool = False) -> None:
        if _is_text(tokens.type):
            tokens = split_lines(tokens) if lines else split_simple(tokens)
        self.size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        self.words, self.ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.f = word_bits(self.words, links)[self.ids]
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.end = np.cumsum(self.size)

    def starts(self, n: int) -> np.ndarray:
        """Places of the filtered n-grams' first tokens."""
        f = self.f
        if n == 1:
            return np.flatnonzero(f & (STOP | BOUNDARY | EDGE) == 0)
        if len(f) < n:
            return np.empty(0, dtype=np.int64)
        p = [f[k : len(f) - n + 1 + k] for k in range(n)]
        every = reduce(np.bitwise_or, p)
        keep = sum((x & AT) for x in p) <= AT
        if n == 2:
            keep &= every & (TOO_COMMON | EDGE | BOUNDARY | JUNK | HASH | LINK) == 0
        else:
            keep &= (p[0] & (TOO_COMMON | LEFT | JUNK) == 0) & (p[-1] & (TOO_COMMON | RIGHT | JUNK) == 0) & (every & (BOUNDARY | HASH | LINK) == 0)
        at = np.flatnonzero(keep)
        row = self.row[at]
        said = np.cumsum(f & AT == 0)  # leading mentions begin no n-gram
        begin = self.end[row] - self.size[row]
        before = np.where(begin > 0, said[begin - 1], 0)
        return at[(at + n <= self.end[row]) & (said[at] > before)]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of all filtered n-grams, their numbers, and a place of each number."""
        at = self.starts(n)
        key, width = self.ids[at], max(1, int(len(self.words) - 1).bit_length())
        bits = width
        for k in range(1, n):
            if bits + width > 63:  # one message of very many words
                key = pa.array(key).dictionary_encode().indices.to_numpy().astype(np.int64)
                bits = max(1, len(key).bit_length())
            key, bits = key << width | self.ids[at + k], bits + width
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        number = np.empty(len(key), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        return self.row[at], number, at[order[new]]

    def counts(self, n: int, docs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A place of each filtered n-gram, how often it occurs, and (``docs``) in how many rows."""
        row, number, first = self.grams(n)
        cnt = np.bincount(number, minlength=len(first))
        if not docs or not len(row):
            return first, cnt, cnt
        return first, cnt, np.bincount(_distinct(row * len(first) + number) % len(first), minlength=len(first))

    def spelled(self, at: np.ndarray, n: int, between: str = " ") -> pa.Array:
        """The n-grams at some places."""
        words = [self.words.take(pa.array(self.ids[at + k])) for k in range(n)]
        return words[0] if n == 1 else pc.binary_join_element_wise(*words, between)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        letters, ends = _strings(self.words)
        size = np.diff(ends).astype(np.int64)
        place = np.arange(len(letters), dtype=np.int64) - np.repeat(ends[:-1].astype(np.int64), size)
        # a sum over a word's letters of pseudo-random numbers, one for each letter and place
        sums = np.zeros(len(letters) + 1, dtype=np.uint64)
        np.cumsum(mixed((place.astype(np.uint64) << np.uint64(8) | letters) + np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
        return mixed(sums[ends[1:]] - sums[ends[:-1]] + size.astype(np.uint64))

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """64-bit hashes of the n-grams at some places, the same in all blocks."""
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            h = mixed(h * np.uint64(3) + self.word_hashes[self.ids[at + k]])
        return h


def token_blocks(batch: pa.RecordBatch, column: int, most: int = BLOCK_TOKENS) -> Iterator[pa.RecordBatch]:
    """A batch in parts with ``most`` tokens (of texts: by their bytes), or of one row."""
    tokens = batch.column(column)
    of_text = _is_text(tokens.type)
    size = pc.fill_null(pc.binary_length(tokens) if of_text else pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    most *= TOKEN_BYTES if of_text else 1
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(size):
        yield batch.slice(start)


def with_links(df: DataFrame, columns: tuple[str, ...], tokens: str, urls: bool) -> DataFrame:
    """The columns, and ``__toks`` and ``__links``: a row's tokens and those of them that hold a URL.

    Strings are split in workers: without ``urls`` they are texts in lower case with simple tokens, else ``lines``.
    """
    if urls and isinstance(df.schema[tokens].dataType, T.StringType):
        if "links" not in df.columns:
            raise ValueError("simple tokens are no URLs")
        return df.select(*columns, F.col(tokens).alias("__toks"), F.col("links").alias("__links"))
    toks, none = F.col(tokens), F.array().cast("array<string>")
    may = lambda t: (F.contains(t, F.lit(".")) | F.contains(t, F.lit("/"))) & text.has_url(t)
    return df.select(*columns, toks.alias("__toks"), (F.filter(toks, may) if urls else none).alias("__links"))


def lines(df: DataFrame, keep: tuple[str, ...], tokens: Column) -> DataFrame:
    """(keep..., line, links): tokens that are not empty and hold no space, joined by spaces, and those of them that hold a URL."""
    said = df.select(*keep, F.array_join(tokens, " ").alias("line"))
    some = F.rlike("line", F.lit("[^ ][./]|[./][^ ]"))  # a token of several characters, one of them a stop or a slash
    found = F.filter(F.split("line", " "), lambda t: (F.contains(t, F.lit(".")) | F.contains(t, F.lit("/"))) & text.has_url(t))
    return said.withColumn("links", F.when(some, found).otherwise(F.array().cast("array<string>")))


@lru_cache(1 << 14)
def _known(uri: str, part: int) -> np.ndarray:
    try:
        return map_array(f"{uri}/{part}", "<u8")
    except FileNotFoundError:  # none of its hashes begins so
        return np.empty(0, dtype="<u8")


def _parts(h: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """The parts of sorted hashes with equal first ``bits``, and where each begins and ends."""
    part, first = np.unique((h >> np.uint64(64 - bits)).astype(np.int64), return_index=True)
    return zip(part.tolist(), first.tolist(), [*first[1:].tolist(), len(h)][: len(part)], strict=True)


@dataclass(frozen=True)
class Among:
    """Hashes of n-grams in sorted files of the shared folder, one for each value of their first ``bits``; workers map them."""

    uri: str
    bits: int

    def has(self, h: np.ndarray) -> np.ndarray:
        """Which hashes are there: those of all n-grams that were given, and hardly any other."""
        order, found = np.argsort(h), np.zeros(len(h), dtype=bool)
        h = h[order]
        for part, a, b in _parts(h, self.bits):
            known = _known(self.uri, part)
            if len(known):
                found[order[a:b]] = known[np.minimum(np.searchsorted(known, h[a:b]), len(known) - 1)] == h[a:b]
        return found


PACKED = "part long, hashes binary"


def packed(h: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted hashes, a row for each part."""
    parts = list(_parts(h, bits))
    return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in parts], pa.int64()), pa.array([h[a:b].tobytes() for _, a, b in parts], pa.binary())], names=["part", "hashes"])


def filed_hashes(dealt: DataFrame, known: Among) -> Among:
    """Write rows of ``packed`` to the files of ``known``."""

    def write(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        write_array(f"{known.uri}/{part}", np.unique(np.frombuffer(b"".join(table["hashes"].to_pylist()), dtype="<u8")))
        return pa.table({"part": pa.array([part], pa.int64())})

    with passing(dealt.sparkSession):
        dealt.groupBy("part").applyInArrow(lambda t: write(t), "part long").count()
    return known


def among(phrases: DataFrame) -> Among:
    """The n-grams of a table (n, ngram) that is read twice."""
    known = Among(new_path(phrases.sparkSession, "phrases"), max(4, (phrases.count() >> 16).bit_length()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = Block(pc.split_pattern(batch.column(0), " "), frozenset())
            sizes = [(n, (block.end - block.size)[block.size == n]) for n in np.unique(block.size).tolist()]
            h = np.sort(np.concatenate([np.empty(0, dtype=np.uint64), *(block.hashes(at, n) for n, at in sizes)]))
            yield packed(h, known.bits)

    return filed_hashes(phrases.select("ngram").mapInArrow(pack, PACKED), known)


def _bits(df: DataFrame, shift: int = 22) -> int:
    """First bits of hashes to deal n-grams by, so that a part is of a few MB (``2 ** shift`` bytes of the table); by Catalyst's estimate, which decides nothing else."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(12, max(5, (size >> shift).bit_length()))


def _planes(h: np.ndarray) -> bytes:
    """Sorted hashes as the bytes of their differences: all least bytes, then all second ones and so on; the greatest are 0 and compress."""
    return np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(stored: bytes) -> np.ndarray:
    steps = np.frombuffer(stored, dtype=np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u8").ravel(), dtype=np.uint64)


def tally(df: DataFrame, tokens: str = "toks", urls: bool = True, once: bool = False, least: int | None = None) -> tuple[DataFrame, Among | None]:
    """(big_n, types_1, types_2, types_3), one row: how many tokens there are, and how many different filtered n-grams.

    ``least``: also the hashes of n-grams that occur so often, or (``once``) in so many rows.
    Only hashes (and, for ``least``, counts) are exchanged, each part of them as one row of bytes.
    """
    given, bits = with_links(df, (), tokens, urls), _bits(df, 24)
    often = Among(new_path(df.sparkSession, "often"), bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share in (p for batch in batches for p in token_blocks(batch, 0)):
            block = Block(share.column(0), frozenset(share.column(1).flatten().to_pylist()), urls)
            out = [(0, 0, b"", int(block.size.sum()).to_bytes(4, "little"))]
            for n in (1, 2, 3):
                if least is None:
                    h = np.sort(block.hashes(block.grams(n)[2], n))
                    out += [(p, n, _planes(h[a:b]), b"") for p, a, b in _parts(h, bits)]
                    continue
                first, _, cnt = block.counts(n, once)
                h = block.hashes(first, n)
                order = np.argsort(h)
                h, cnt = h[order], cnt[order].astype("<u4")
                out += [(p, n, _planes(h[a:b]), cnt[a:b].tobytes()) for p, a, b in _parts(h, bits)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "n", "hashes", "times"])

    def merge(table: pa.Table) -> pa.Table:
        ns, value, kept = table["n"].to_numpy(), [], []
        hashes, times = table["hashes"].to_pylist(), table["times"].to_pylist()
        for n in (0, 1, 2, 3):
            mine = np.flatnonzero(ns == n).tolist()
            h = np.concatenate([np.empty(0, dtype=np.uint64), *(_from_planes(hashes[i]) for i in mine if n)])
            if n and least is None:
                value.append(len(_distinct(h)))
                continue
            cnt = np.frombuffer(b"".join(times[i] for i in mine), dtype="<u4").astype(np.int64)
            if n == 0:
                value.append(int(cnt.sum()))
                continue
            order = np.argsort(h)
            h = h[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, dtype=np.int64)
            value.append(len(first))
            if least is not None and len(first):
                kept.append(h[first][np.add.reduceat(cnt[order], first) >= least])
        if kept:
            write_array(f"{often.uri}/{table['part'][0].as_py()}", np.unique(np.concatenate(kept)))
        return pa.table({c: pa.array([v], pa.int64()) for c, v in zip(TOTALS, value, strict=True)})

    dealt = given.mapInArrow(pack, "part long, n int, hashes binary, times binary").groupBy("part")
    sums = dealt.applyInArrow(lambda t: merge(t), ", ".join(f"{c} long" for c in TOTALS))
    info = materialize(sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS]), "model-info")
    return info, None if least is None else often


TOTALS = ("big_n", "types_1", "types_2", "types_3")


def sums(df: DataFrame, tokens: str = "toks", urls: bool = True, orders: tuple[int, ...] = (1, 2, 3), once: bool = False, docs: bool = False) -> DataFrame:
    """(n, ngram, cnt): how often each filtered n-gram occurs, or (``once``) in how many rows; ``docs`` adds the latter.

    N-grams are exchanged in parts by their hash, each part of a block as one row of bytes,
    and a part is grouped by the n-grams themselves.
    """
    given, bits = with_links(df, (), tokens, urls), _bits(df)
    schema = "n int, ngram string, cnt long" + ", docs long" * docs

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share in (p for batch in batches for p in token_blocks(batch, 0)):
            block = Block(share.column(0), frozenset(share.column(1).flatten().to_pylist()), urls)
            out = []
            for n in orders:
                first, cnt, own = block.counts(n, once or docs)
                part = (block.hashes(first, n) >> np.uint64(64 - bits)).astype(np.int16)
                order = np.argsort(part, kind="stable")
                spelled = block.spelled(first[order], n)
                ends = np.frombuffer(spelled.buffers()[1], dtype=np.int32)[spelled.offset : spelled.offset + len(spelled) + 1] if len(spelled) else np.zeros(1, dtype=np.int32)
                letters = memoryview(spelled.buffers()[2] or b"")
                size, cnt, own = (x.astype("<u4") for x in (np.diff(ends), (own if once else cnt)[order], own[order]))
                part, begin = np.unique(part[order], return_index=True)
                for p, a, b in zip(part.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)][: len(part)], strict=True):
                    out.append((p, n, letters[ends[a] : ends[b]], size[a:b].tobytes(), cnt[a:b].tobytes(), own[a:b].tobytes() if docs else b""))
            if out:
                binary = pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), binary, binary, binary, binary), strict=True)], names=["part", "n", "letters", "sizes", "times", "docs"])

    def merge(table: pa.Table) -> pa.Table:
        whole = lambda c: b"".join(table[c].to_pylist())
        size, letters = np.frombuffer(whole("sizes"), dtype="<u4"), whole("letters")
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        grams = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(letters)])
        numbers = {c: pa.array(np.frombuffer(whole(t), dtype="<u4").astype(np.int64)) for c, t in (("cnt", "times"), ("docs", "docs"))[: 1 + docs]}
        out = pa.table({"ngram": grams, **numbers}).group_by("ngram", use_threads=False).aggregate([(c, "sum") for c in numbers])
        n = pa.array(np.full(len(out), table["n"][0].as_py(), dtype=np.int32))
        return pa.table({"n": n, "ngram": out["ngram"].cast(pa.string()), **{c: out[f"{c}_sum"] for c in numbers}})

    dealt = given.mapInArrow(pack, "part long, n int, letters binary, sizes binary, times binary, docs binary")
    return dealt.groupBy("n", "part").applyInArrow(lambda t: merge(t), schema)


def occurrences(
    df: DataFrame, tokens: str = "toks", keep: tuple[str, ...] = ("doc_id",), urls: bool = True, orders: tuple[int, ...] = (1, 2, 3), once: bool = False, totals: bool = False, summed: bool = False, docs: bool = False, only: Among | None = None
) -> DataFrame:
    """(keep..., n, ngram): a row for every filtered n-gram of every row of ``df``.

    ``once``: without a row's repeats, which takes no shuffle. ``totals`` adds a column
    ``times``, 1 for an n-gram, and a row of n 0 with the number of a row's tokens.
    ``summed``: rows of one block of messages that are equal, which need no ``keep``, are one
    row with the sum of their times; ``docs`` adds of how many messages they are. ``only``:
    n-grams that are there, and hardly any other.

    Workers number the words of a block of messages and filter and count n-grams by those
    numbers, all at once; only what is returned is spelled.
    """
    if summed and keep or docs and not summed:
        raise ValueError("rows of different messages are no sum of theirs")
    given = with_links(df, keep, tokens, urls)
    times = totals or summed
    fields = [*(given.schema[k] for k in keep), T.StructField("n", T.IntegerType(), False), T.StructField("ngram", T.StringType(), False)]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType(), False) for c in ("times", "docs")[: times + docs])])
    at, names = len(keep), schema.names

    def rows_of(part: pa.RecordBatch, row: np.ndarray | None, n: int, ngram: pa.Array, *numbers: np.ndarray) -> pa.RecordBatch:
        kept = [part.column(i).take(pa.array(row)) for i in range(at)]
        return pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(ngram), n, dtype=np.int32)), ngram, *(pa.array(x.astype(np.int64)) for x in numbers[: times + docs])], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in token_blocks(batch, at)):
            block = Block(part.column(at), frozenset(part.column(at + 1).flatten().to_pylist()), urls)
            for n in orders:
                row, number, first = block.grams(n)
                if only is not None:
                    some = only.has(block.hashes(first, n))
                    row, number, first = row[some[number]], (np.cumsum(some) - 1)[number[some[number]]], first[some]
                cnt = np.bincount(number, minlength=len(first))
                if (once or docs) and len(row):
                    pair = _distinct(row * len(first) + number)
                    row, number = pair // len(first), pair % len(first)
                spelled = block.spelled(first, n)
                if summed:
                    own = np.bincount(number, minlength=len(first)) if once or docs else cnt
                    yield rows_of(part, None, n, spelled, own if once else cnt, own)
                else:
                    yield rows_of(part, row, n, spelled.take(pa.array(number)), np.ones(len(number)))
            if totals:
                size = np.asarray([block.size.sum()]) if summed else block.size
                yield rows_of(part, np.arange(len(size)), 0, pa.array([""] * len(size), pa.string()), size, size * 0 + part.num_rows)

    return given.mapInArrow(work, schema)


def postings(df: DataFrame, tokens: str = "toks", urls: bool = True, orders: tuple[int, ...] = (1, 2, 3), only: Among | None = None) -> DataFrame:
    """(doc_id, n, ngram) without repeats; ``only``: of n-grams that are there, and hardly any other."""
    return occurrences(df, tokens, ("doc_id",), urls, orders, once=True, only=only)


def feature_line(tokens: Column | str, urls: bool = True) -> Column:
    """Filtered unigrams, then filtered bigrams joined by ``_``, in one line; clitics are whole again before."""
    tokens = text.lower_tokens(text.rejoin_clitics(tokens))
    pairs = F.transform(filtered(tokens, 2, urls), lambda g: F.replace(g, F.lit(" "), F.lit("_")))
    return F.array_join(F.concat(filtered(tokens, 1, urls), pairs), " ")


def features(df: DataFrame, tokens: str = "toks", keep: tuple[str, ...] = ("doc_id",), urls: bool = True) -> DataFrame:
    """(keep..., features): what ``feature_line`` joins, as an array, of every row; found by numbered words in workers."""
    rows = df.select(*keep, text.lower_tokens(text.rejoin_clitics(tokens)).alias("__rejoined"))
    given, at = with_links(rows, keep, "__rejoined", urls), len(keep)
    schema = T.StructType([*(given.schema[k] for k in keep), T.StructField("features", T.ArrayType(T.StringType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in token_blocks(batch, at)):
            block = Block(part.column(at), frozenset(part.column(at + 1).flatten().to_pylist()), urls)
            one, two = block.starts(1), block.starts(2)
            row = np.concatenate([block.row[one], block.row[two]])
            order = np.argsort(row, kind="stable")
            grams = pa.concat_arrays([block.spelled(one, 1), block.spelled(two, 2, "_")]).take(pa.array(order))
            ends = np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at)), pa.ListArray.from_arrays(pa.array(ends), grams)], names=schema.names)

    return given.mapInArrow(work, schema)


def counted(df: DataFrame, orders: tuple[int, ...], tokens: str = "toks", urls: bool = True) -> DataFrame:
    """(n, ngram, cnt, docs): how often and under how many doc_ids each filtered n-gram occurs."""
    again = _repeated(df)
    if again is None:
        return sums(df, tokens, urls, orders, docs=True)
    same = df["doc_id"].eqNullSafe(again["__id"])
    one = sums(df.join(again, same, "left_anti"), tokens, urls, orders, docs=True)
    more = occurrences(df.join(again, same, "left_semi"), tokens, ("doc_id",), urls, orders).groupBy("n", "ngram").agg(F.count("*").alias("cnt"), F.countDistinct("doc_id").alias("docs"))
    return one.unionByName(more).groupBy("n", "ngram").agg(F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs"))


def _repeated(df: DataFrame) -> DataFrame | None:
    """The doc_ids that several rows have or that are null, which rows can't stand for; None if there are none."""
    again = materialize(df.groupBy(F.col("doc_id").alias("__id")).count().where("count > 1 or __id is null").select("__id"), "repeated")
    return None if again.isEmpty() else again


def followers(df: DataFrame, tokens: str = "toks", urls: bool = True) -> DataFrame:
    """(first, followers, docs) of filtered bigrams by their first word: how many different second words it has, and in how many doc_ids."""
    grams = occurrences(df, tokens, (), urls, (2,), summed=True).select("ngram").repartition("ngram").distinct()
    second = grams.groupBy(F.substring_index("ngram", " ", 1).alias("first")).agg(F.count("*").alias("followers"))
    again = _repeated(df)
    alone = df if again is None else df.join(again, df["doc_id"].eqNullSafe(again["__id"]), "left_anti")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in token_blocks(batch, 0)):
            block = Block(part.column(0), frozenset(part.column(1).flatten().to_pylist()), urls)
            at = block.starts(2)
            pair = pa.array(block.row[at] * len(block.words) + block.ids[at]).unique().to_numpy()
            count = np.bincount(pair % max(1, len(block.words)), minlength=len(block.words))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([block.words.take(pa.array(some)), pa.array(count[some].astype(np.int64))], names=["first", "docs"])

    docs = with_links(alone, (), tokens, urls).mapInArrow(work, "first string, docs long")
    if again is not None:
        more = neighbours(df.join(again, df["doc_id"].eqNullSafe(again["__id"]), "left_semi"), tokens, urls)
        docs = docs.unionByName(more.groupBy("first").agg(F.countDistinct("doc_id").alias("docs")))
    return second.join(docs.groupBy("first").agg(F.sum("docs").alias("docs")), "first")


def neighbours(df: DataFrame, tokens: str = "toks", urls: bool = True) -> DataFrame:
    """(first, second, doc_id) of filtered bigrams, for look-ups by either word."""
    grams = postings(df, tokens, urls, (2,))
    parts = F.split("ngram", " ")
    return grams.select(parts[0].alias("first"), parts[1].alias("second"), "doc_id")
