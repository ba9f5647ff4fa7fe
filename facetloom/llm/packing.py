"""Best-fit packing of tokenized documents, planned on the histogram of their lengths.

A document is its token ids and one end id. Documents longer than a sequence are cut into
whole sequences and a rest; other documents stay whole. Best-fit decreasing then runs over
the counts of the lengths, not over documents: a group of sequences with the same free
room is a range of sequence ids, so a plan has a few rows for each length, however many
documents there are. Pieces take the planned slots by their rank within their length.

Ranks are two-level: pieces are dealt over ``BUCKETS`` buckets of each length, numbered
there, and shifted by the counts of the buckets before, so a length that a third of all
pieces have is no single task's work. Those counts have at most ``TOKENS * BUCKETS`` rows
(1 MB as an array) whatever the input, so they are broadcast: no join sorts the pieces.

Tokens never span white space in this vocabulary, so each distinct word is tokenized once
per worker and remembered; texts in which a special token is spelled out are tokenized
whole.

Defined cases: a null or empty text is the end id alone; a null doc_id is kept as null;
rows that repeat are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetloom.llm.common import map_arrow, table, utf8
from facetloom.shared import materialize

TOKENS = 4096
END_ID = 1
BUCKETS = 32
#: Bytes of words and ids that a worker remembers.
MEMO_BYTES = 128 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int"


#: Letters below this code point are tokenized by the merges alone, without the tokenizer's Unicode passes.
PLAIN_LETTERS = 0x180
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> list[str]:
    """The vocabulary's letter for each byte: printable ones stand for themselves, others follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordTokenizer:
    """Little-endian uint32 ids of texts, with a memory of words.

    A word is what stands between white space. Marks that follow common letters are a run of
    their own, so such a word is remembered without them; its letters go straight to the
    merges. The memory has two generations: words of the older one that occur again are
    kept, the others are forgotten.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def keep(self, word: bytes, ids: bytes) -> bytes:
        self.memo[word] = ids
        self.held += len(word) + len(ids) + 160
        return ids

    def plain(self, word: bytes) -> str:
        """A word of common letters, lower-cased; empty for others."""
        if word.isalpha():
            return word.decode()
        text = unicodedata.normalize("NFC", word.decode()).lower()
        return text if text.isalpha() and max(text) < chr(PLAIN_LETTERS) else ""

    def common(self, word: bytes) -> bytes:
        """Ids of a word of common letters with A-Z lower-cased; empty for others."""
        text = self.plain(word)
        if not text:
            return b""
        ids = self.memo.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                found = [t.id for t in self.merge(text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode())))]
                ids = struct.pack(f"<{len(found)}I", *found)
            self.keep(word, ids)
        return ids

    def learn(self, words: set[bytes]) -> None:
        if self.held > MEMO_BYTES // 2:
            self.memo, self.old, self.held = {}, self.memo, 0
        for w in words.difference(self.memo):
            ids = self.old.get(w)
            if ids is None:
                low = w.lower()
                core = low.rstrip(MARKS)
                ids = core and self.common(core)
                if not ids:
                    ids = self.whole(low.decode())
                elif len(core) < len(low):
                    tail = low[len(core) :]
                    ids += self.memo.get(tail) or self.keep(tail, self.whole(tail.decode()))
            self.keep(w, ids)

    def __call__(self, texts: list[bytes | None]) -> Iterator[bytes]:
        for text in texts:
            if text and b"<|" in text:
                yield self.whole(text.decode())
                continue
            words = (text or b"").split()
            try:
                yield b"".join(map(self.memo.__getitem__, words))
            except KeyError:
                self.learn(set(words))
                yield b"".join(map(self.memo.__getitem__, words))


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """A worker's tokenizer, whose memory of words lasts from task to task."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, end_id: int = END_ID, buckets: int = BUCKETS) -> DataFrame:
    """A row for each piece of each document: its place in the document, length, checksum and bucket."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, deal = word_tokenizer(tokenizer), np.asarray([end_id], dtype="<u4").tobytes(), 0
        step = 4 * tokens
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(utf8(batch.column("text"))), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    crc = zlib.crc32(part)
                    deal += 1
                    for c, v in zip(out, (doc_id, k, at // 4, len(part) // 4, crc, (deal * 40503 + crc) % buckets), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "bucket"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), cut, PIECES)


def plan(counts: dict[int, int], room: int = TOKENS) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over the counts of lengths.

    Rows (length, first rank, pieces, first sequence, pieces a sequence, offset): the piece
    of rank r goes into sequence ``first + (r - first rank) // each`` at
    ``offset + (r - first rank) % each * length``. Groups of sequences with equal room grow
    by two at most for each length, so the plan's size depends on ``room`` alone.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # free room: ranges of sequences
    rows, used = [], 0

    def put(free: int, first: int, n: int) -> None:
        if n and free:
            groups.setdefault(free, []).append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for free in sorted(f for f in groups if f >= length):
            each, ranges = free // length, groups.pop(free)
            while ranges and left:
                first, n = ranges.pop()
                full = min(n, left // each)
                rest = min(left - full * each, each - 1) if full < n else 0
                for begin, many, held in ((first, full, each), (first + full, 1, rest)):
                    if many and held:
                        rows.append((length, rank, many * held, begin, held, room - free))
                        rank, left = rank + many * held, left - many * held
                        put(free - held * length, begin, many)
                spent = full + (rest > 0)
                if spent < n:
                    ranges.append((first + spent, n - spent))
            for first, n in ranges:
                put(free, first, n)
            if not left:
                break
        if left:
            each = room // length
            full, rest = divmod(left, each)
            for many, held in ((full, each), (1, rest)):
                if many and held:
                    rows.append((length, rank, many * held, used, held, 0))
                    put(room - held * length, used, many)
                    rank, used = rank + many * held, used + many
    return rows


def place(cut: DataFrame, room: int = TOKENS, buckets: int = BUCKETS) -> DataFrame:
    """Adds sequence_id and offset to materialized pieces, by rank within their length."""
    counts = cut.groupBy("length", "bucket").count().toArrow()  # a row for each length and bucket
    first = np.zeros((room + 1, buckets + 1), dtype=np.int64)  # of a bucket: pieces of its length in the buckets before
    first[counts["length"].to_numpy(), counts["bucket"].to_numpy() + 1] = counts["count"].to_numpy()
    first = np.cumsum(first, axis=1)
    rows = sorted(plan({n: int(first[n, -1]) for n in np.flatnonzero(first[:, -1]).tolist()}, room))
    key = np.asarray([r[0] << 44 | r[1] for r in rows], dtype=np.int64)
    slots = cut.sparkSession.sparkContext.broadcast((key, np.asarray(rows, dtype=np.int64).reshape(-1, 6), first))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = cut.withColumn("n", F.row_number().over(within))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, first = slots.value
        for batch in batches:
            length, bucket, n = (batch.column(c).to_numpy() for c in ("length", "bucket", "n"))
            rank = first[length, bucket] + n - 1
            row = rows[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            at = rank - row[:, 1]
            sequence, offset = row[:, 3] + at // np.maximum(row[:, 4], 1), row[:, 5] + at % np.maximum(row[:, 4], 1) * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return map_arrow(ranked, take, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return place(materialize(pieces(docs, tokenizer, tokens, end_id), "pieces"), tokens)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
