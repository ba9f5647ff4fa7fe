"""Texts scored by an interpolated modified Kneser-Ney bigram model of the corpus itself.

Spark counts words, then pairs of neighbouring words, over every training text. The model
is a set of sorted arrays in the shared folder, which workers map into memory:

  words   hashes of the words in order; beside them each word's count, the count of the
          words before it, in how many distinct pairs it is second, and in how many pairs
          of one, two, and three or more it is first. A word's number is its place.
  pairs   numbers of the first and second word as one sorted integer, and counts.

Word arrays are cut by hash, pair arrays by the running count of the first word: buckets
have like shares of the corpus, and a word with a large share spans several of them,
dealt out by the second word. Every exchange carries sorted, difference-coded blocks that
were summed before. What is gathered on the driver is one row for each word bucket, of
which there are ``WORD_BUCKETS`` at most; that table goes with every task. Workers visit
the buckets that their texts need and hold ``MAPS`` of each kind of mapping at most, for
an operating system limits how many a process may have.

Order two is the production order: the table documents at sf0.1 has 0.74 distinct trigrams
a token, so their exchange would be about as large as the tokens themselves.

Defined cases: a null or empty text is the end token alone; a null doc_id is not held out;
repeated rows are counted and scored each; without training texts N and V are 0 and every
token has probability 1; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.llm.common import blocks, map_array, map_arrow, pack_sorted, parts, remainder, summed, table, unpack_sorted, utf8, write_array
from facetloom.shared import materialize, new_path

FOLDS, HELD_OUT = 7, 2
#: Bytes of text for a bucket of words, and tokens for a bucket of pairs.
WORD_BUCKET, PAIR_BUCKET = 32 << 20, 2_000_000
#: Word buckets at most (beyond, each has more text), and mappings that a worker holds of words and of pairs.
WORD_BUCKETS, MAPS = 1 << 16, 1 << 13
BLOCK = 8 << 20
PACKED = "bucket int, keys binary, counts binary"


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


#: No word holds a space.
BEGIN, END = " begin", " end"


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of begin, words and end of each text in turn, and the places of the begins."""
    import xxhash

    begin, end = _hash(BEGIN.encode()), _hash(END.encode())
    runs, starts, at = [], [], 0
    for text in texts:
        words = (text or b"").lower().split()
        hashes = np.empty(len(words) + 2, dtype=np.uint64)
        hashes[0], hashes[-1] = begin, end
        hashes[1:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        runs.append(hashes)
        starts.append(at)
        at += len(hashes)
    return np.concatenate(runs) if runs else np.empty(0, dtype=np.uint64), np.asarray(starts, dtype=np.int64)


def _word_bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of the hash, so they keep its order."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _packed(bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket; rows are sorted by bucket and key."""
    rows = [(k, *pack_sorted(keys[part], counts[part])) for k, part in parts(bucket)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "keys", "counts"])


def _unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    packed = [unpack_sorted(k, c) for k, c in zip(group.column("keys").to_pylist(), group.column("counts").to_pylist(), strict=True)]
    return summed(np.concatenate([p[0] for p in packed]), np.concatenate([p[1] for p in packed]))


class Words:
    """The word arrays; ``base`` has the number and the running count at which each bucket begins."""

    def __init__(self, path: str, base: list[tuple[int, int]]) -> None:
        self.path, self.base, self.n = path, base, len(base)
        self.array = lru_cache(MAPS)(lambda name, bucket, dtype: map_array(f"{path}/{name}-{bucket}", dtype))

    def look_up(self, hashes: np.ndarray, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
        """Numbers (-1: unknown) of sorted distinct hashes, and their values in the named arrays."""
        numbers = np.full(len(hashes), -1, dtype=np.int64)
        values = [np.zeros((len(hashes), 3) if n == "follow" else len(hashes), dtype=np.int64) for n in names]
        for b, part in parts(_word_bucket(hashes, self.n)):
            known = self.array("hash", b, "<u8")
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, hashes[part]), len(known) - 1)
            found = known[at] == hashes[part]
            numbers[part] = np.where(found, at + self.base[b][0], -1)
            for name, out in zip(names, values, strict=True):
                if name == "before":
                    out[part] = self.array(name, b, "<i8")[at] + self.base[b][1]
                elif name == "follow":
                    out[part] = self.array(name, b, "<i8").reshape(-1, 3)[at] * found[:, None]
                else:
                    out[part] = self.array(name, b, "<i8")[at] * found
        return numbers, values


def _pair_bucket(first: np.ndarray, second: np.ndarray, before: np.ndarray, count: np.ndarray, share: float, n: int) -> np.ndarray:
    spread = (second.astype(np.uint64) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2**32
    return np.minimum(((before + spread * count) / share).astype(np.int64), n - 1)


def discounts(t: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2, and 3 or more, from how many n-grams have counts 1 to 4."""
    t1, t2, t3, t4 = (float(x) for x in t)
    if not (t1 and t2):
        return np.array([0.5, 0.5, 0.5])  # too few counts to estimate from
    y = t1 / (t1 + 2 * t2)
    raw = np.array([1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3 if t3 else 3 * y])
    return np.clip(raw, 0.01, [1, 2, 3])


class Model:
    """A trained model: where its arrays are, and its totals."""

    def __init__(self, path: str, base: list[tuple[int, int]], tokens: int, types: int, begins: int) -> None:
        self.path, self.base, self.tokens, self.types = path, base, tokens, types
        #: every training token is second in one pair
        self.buckets = max(1, -(-tokens // PAIR_BUCKET))
        self.share = max(1.0, (tokens + begins) / self.buckets)
        self.pairs = 0
        self.high = self.low = np.full(3, 0.5)
        self.low_kinds = np.zeros(3)


def train(docs: DataFrame) -> Model:
    """Count words and pairs of all rows of ``docs`` (with a column text) into the shared folder."""
    spark = docs.sparkSession
    path = new_path(spark, "lm")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(max(1, -(-size // WORD_BUCKET)), WORD_BUCKETS)
    docs = docs.select("text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in blocks([len(t or b"") for t in texts], BLOCK):
                keys, counts = np.unique(tokens_of(texts[a:b])[0], return_counts=True)
                yield _packed(_word_bucket(keys, n), keys, counts)

    def store_words(key, group):
        bucket = key[0].as_py()
        keys, counts = _unpacked(group)
        write_array(f"{path}/hash-{bucket}", keys.astype("<u8"))
        write_array(f"{path}/count-{bucket}", counts.astype("<i8"))
        write_array(f"{path}/before-{bucket}", (np.cumsum(counts) - counts).astype("<i8"))
        begin = int(counts[keys == np.uint64(_hash(BEGIN.encode()))].sum())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "types": [len(keys)], "tokens": [int(counts.sum())], "begins": [begin]})

    words = map_arrow(docs, count_words, PACKED).groupBy("bucket").applyInArrow(store_words, "bucket int, types long, tokens long, begins long")
    rows = {r.bucket: r for r in words.collect()}  # a row for each bucket
    for b in set(range(n)) - set(rows):
        for name in ("hash", "count", "before"):
            write_array(f"{path}/{name}-{b}", np.empty(0, dtype="<i8"))
    base, types, tokens, begins = [], 0, 0, 0
    for b in range(n):
        base.append((types, tokens))
        if b in rows:
            types, tokens, begins = types + rows[b].types, tokens + rows[b].tokens, begins + rows[b].begins
    if types >= 1 << 32:
        raise OverflowError("a pair is stored as two numbers of 32 bits: there are too many distinct words")
    model = Model(path, base, tokens - begins, types - (begins > 0), begins)
    edges = np.asarray([first for first, _ in base] + [types])
    share, buckets = model.share, model.buckets

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path, base)
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in blocks([len(t or b"") for t in texts], BLOCK):
                hashes, starts = tokens_of(texts[a:b])
                known, place = np.unique(hashes, return_inverse=True)
                numbers, (before, count) = words.look_up(known, "before", "count")
                number = numbers[place]
                keep = np.ones(len(number) - 1, dtype=bool)
                keep[starts[1:] - 1] = False
                keys, counts = np.unique((number[:-1][keep] << 32 | number[1:][keep]).astype(np.uint64), return_counts=True)
                first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
                at = np.searchsorted(numbers, first)  # hashes and numbers have one order
                bucket = _pair_bucket(first, second, before[at], count[at], share, buckets)
                order = np.argsort(bucket, kind="stable")
                yield _packed(bucket[order], keys[order], counts[order])

    def store_pairs(key, group):
        bucket = key[0].as_py()
        keys, counts = _unpacked(group)
        write_array(f"{path}/pair-{bucket}", keys.astype("<u8"))
        write_array(f"{path}/seen-{bucket}", np.minimum(counts, 0xFFFFFFFF).astype("<u4"))
        firsts, seconds = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        out: dict[str, list] = {"bucket": [], "kind": [], "keys": [], "counts": [], "n": []}
        for kind, ids in enumerate((seconds, *(firsts[np.minimum(counts, 3) == c] for c in (1, 2, 3)))):
            ids, n = np.unique(ids, return_counts=True)
            cut = np.searchsorted(ids.astype(np.int64), edges)
            for b in np.flatnonzero(np.diff(cut)).tolist():
                k, c = pack_sorted(ids[cut[b] : cut[b + 1]], n[cut[b] : cut[b + 1]])
                for name, v in zip(out, (b, kind, k, c, 0), strict=True):
                    out[name].append(v)
        for c in (1, 2, 3, 4):
            for name, v in zip(out, (-c, 4, b"", b"", int((counts == c).sum())), strict=True):
                out[name].append(v)
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    seen = map_arrow(docs, count_pairs, PACKED).groupBy("bucket").applyInArrow(store_pairs, "bucket int, kind int, keys binary, counts binary, n long")
    seen = materialize(seen, "lm-seen")

    def store_follow(key, group):
        bucket = key[0].as_py()
        n = int(edges[bucket + 1] - edges[bucket])
        table = np.zeros((4, n), dtype=np.int64)
        for kind, k, c in zip(*(group.column(x).to_pylist() for x in ("kind", "keys", "counts")), strict=True):
            ids, counts = unpack_sorted(k, c)
            table[kind, ids.astype(np.int64) - edges[bucket]] += counts
        write_array(f"{path}/after-{bucket}", table[0].astype("<i8"))
        write_array(f"{path}/follow-{bucket}", table[1:].T.astype("<i8"))
        t = [int((table[0] == c).sum()) for c in (1, 2, 3, 4)]
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "t": pa.array([[*t, int((table[0] > 2).sum()), int(table[0].sum())]], pa.list_(pa.int64()))})

    follow = seen.where("bucket >= 0").groupBy("bucket").applyInArrow(store_follow, "bucket int, t array<long>").collect()  # a row for each bucket
    for b in set(range(n)) - {r.bucket for r in follow}:
        write_array(f"{path}/after-{b}", np.zeros(int(edges[b + 1] - edges[b]), dtype="<i8"))
        write_array(f"{path}/follow-{b}", np.zeros(3 * int(edges[b + 1] - edges[b]), dtype="<i8"))
    high = np.zeros(5, dtype=np.int64)
    for r in seen.where("bucket < 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # four rows
        high[-r.bucket] = r.n
    low = np.sum([r.t for r in follow], axis=0) if follow else np.zeros(6, dtype=np.int64)
    model.high, model.low, model.pairs = discounts(high[1:]), discounts(low[:4]), int(low[5])
    model.low_kinds = np.array([low[0], low[1], low[4]], dtype=float)
    return model


class Scorer:
    """Log probabilities of tokens under a model whose arrays are mapped into memory."""

    def __init__(self, model: Model) -> None:
        self.model, self.words = model, Words(model.path, model.base)
        self.pairs = lru_cache(MAPS)(lambda b: (map_array(f"{model.path}/pair-{b}", "<u8"), map_array(f"{model.path}/seen-{b}", "<u4")))

    def seen(self, bucket: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs."""
        out = np.zeros(len(keys), dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        for b, part in parts(bucket[order]):
            known, counts = self.pairs(b)
            rows = order[part]
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[rows]), len(known) - 1)
                out[rows] = counts[at] * (known[at] == keys[rows])
        return out

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        m = self.model
        hashes, starts = tokens_of(texts)
        distinct, place = np.unique(hashes, return_inverse=True)
        numbers, (count, before, after, follow) = self.words.look_up(distinct, "count", "before", "after", "follow")
        uniform = 1.0 / (m.types + 1)
        if m.pairs:
            back = float(m.low @ m.low_kinds) / m.pairs
            low = np.maximum(after - np.where(after > 0, m.low[np.minimum(np.maximum(after, 1), 3) - 1], 0.0), 0.0) / m.pairs + back * uniform
        else:
            low = np.full(len(distinct), uniform)
        base = np.log10((count + 1.0) / (m.tokens + m.types + 1.0))
        is_second = np.ones(len(hashes), dtype=bool)
        is_second[starts] = False
        second = np.flatnonzero(is_second)
        pair, which = np.unique(place[second - 1].astype(np.uint64) << np.uint64(32) | place[second].astype(np.uint64), return_inverse=True)
        v, w = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        both = np.flatnonzero((numbers[v] >= 0) & (numbers[w] >= 0))
        seen = np.zeros(len(pair), dtype=np.int64)
        if len(both) and m.pairs:
            a, b = numbers[v[both]], numbers[w[both]]
            bucket = _pair_bucket(a, b, before[v[both]], count[v[both]], m.share, m.buckets)
            seen[both] = self.seen(bucket, (a << 32 | b).astype(np.uint64))
        total = follow[v].sum(axis=1)  # 0: the word is never first
        context = np.maximum(count[v], 1)
        top = np.maximum(seen - np.where(seen > 0, m.high[np.minimum(np.maximum(seen, 1), 3) - 1], 0.0), 0.0) / context
        weight = np.where(total > 0, follow[v] @ m.high / context, 1.0)
        log = np.log10(top + weight * low[w])
        lengths = np.diff(np.append(starts, len(hashes))) - 1
        edges = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, edges) if len(edges) else np.empty(0)
        return lengths, add((count[place[second]] > 0).astype(np.int64)), add(base[place[second]]), add(log[which])


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` (long or boolean) of ``docs`` with n_tokens, n_known, train_tokens, base_score and score."""
    own = docs.select(*keep, "text")
    kinds = ", ".join(f"{c} {t}" for c, t in docs.select(*keep).dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = utf8(batch.column(len(keep)))
            done = [scorer(texts[a:b]) for a, b in blocks([len(t or b"") for t in texts], BLOCK)]
            n, known, base, log = (np.concatenate([p[i] for p in done]) if done else np.empty(0) for i in range(4))
            columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(list(repeat(model.tokens, len(n))), pa.int64()), pa.array(base, pa.float64()), pa.array(log, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return map_arrow(own, work, f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    return score(docs, train(docs.where(~F.col("held_out"))), ["doc_id", "held_out"])
