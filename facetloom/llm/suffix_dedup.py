"""Removal of byte strings that other documents have, by merging sorted suffix runs.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller doc_id. Suffixes are sampled, without loss: every string of LENGTH bytes is filed
under its anchor, the place inside it whose next ``ANCHOR`` bytes hash least, and equal
strings have their anchors at equal places. Only anchors that two documents share take part.

Whole copies of a text are found first, by its digest: all but the least document's lose
everything and take no further part.

1. Anchors of a block of texts are exchanged as sorted, difference-coded hashes; those that
   two documents share go back to their documents.
2. For each such anchor, the suffix that begins there (LENGTH bytes, then the bytes before
   it in reverse) is an entry. A block's entries are sorted; what a smaller document of the
   block already covers is settled there, the rest is exchanged as front-coded runs.
3. A bucket's runs are merged by a loser tree that keeps, for each contender, the prefix it
   shares with the last winner, and compares bytes beyond known prefixes only.
4. What is covered follows from the shared prefixes alone. Two entries have the string that
   begins j bytes before their anchors in common if they share LENGTH - j bytes from the
   anchor on and j bytes before it. The merged order gives the first as runs between shorter
   shared prefixes, for every j; the same runs over the bytes before the anchors, in order,
   give the second. In each pair of runs, all but the least document's strings are covered.

A passage that a third of all documents have costs one entry for each block. All steps
hold a block, a bucket or a document at a time; nothing is gathered on the driver.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; rows with a null
doc_id come after all others, ordered by a hash of their texts (doc_ids are under 2^62);
rows with one doc_id, or with none and one text, do not remove from one another; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.llm.common import blocks, map_arrow, pack_sorted, parts, table, unpack_sorted, utf8
from facetloom.llm.decontamination import runs as runs_of
from facetloom.operators.components import with_least

LENGTH, ANCHOR = 50, 20
SIDE = LENGTH - ANCHOR
ENTRY = LENGTH + SIDE
#: Bits of a hash that an anchor is chosen by, the rest is its place; all 64 bits are exchanged.
#: Anchors that collide are told apart by their bytes.
BITS = 40
PART = 1 << 20
#: Texts hashed at once, texts whose anchors are sorted at once, and text for one bucket.
STEP, BLOCK, BUCKET = 1 << 18, 2 << 20, 1 << 20
#: Parts that the rows of one digest are dealt over, and buckets for each part beyond that.
SALTS = 64
#: Where rows with a null doc_id begin in the order.
LAST = 1 << 62

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def _anchors(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of documents that stand one after another, and their hashes."""
    n = len(data)
    if n < LENGTH:
        return (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64))
    if n > PART:  # one very long text
        at, parts = 0, []
        while at < n - LENGTH + 1:
            p, h = _anchors(data[at : at + PART], np.asarray([min(PART, n - at)]))
            parts.append((p + at, h))
            at += PART - LENGTH + 1
        place, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = np.flatnonzero(np.diff(place, prepend=-1) > 0)
        return place[first], h[first]
    m = n - ANCHOR + 1
    h = np.ndarray((m,), "<u8", data, 0, (1,)) * _MIX[0]
    h ^= h >> np.uint64(29)
    h += np.ndarray((m,), "<u8", data, 8, (1,)) * _MIX[1]
    h ^= h >> np.uint64(31)
    h += np.ndarray((m,), "<u4", data, 16, (1,)) * _MIX[2]
    h *= _MIX[3]
    low = h >> np.uint64(64 - BITS)
    low <<= np.uint64(24)
    low |= np.arange(m, dtype=np.uint64)
    for width in (1, 2, 4, 8):
        low = np.minimum(low[:-width], low[width:])
    span = SIDE + 1 - 16
    low = np.minimum(low[:-span], low[span:])  # over SIDE + 1 places
    whole = np.ones(n, dtype=bool)
    for i in range(1, LENGTH):
        whole[ends[ends >= i] - i] = False  # an end before byte i crosses nothing
    found = low[whole[: len(low)]]
    if not len(found):
        return (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64))
    found = found[np.concatenate(([True], found[1:] != found[:-1]))]
    place = (found & np.uint64((1 << 24) - 1)).astype(np.int64)
    return place, h[place]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts: the text, the place in it and the hash of every anchor, in order."""
    out = []
    for a, b in blocks([len(t) for t in texts], STEP):
        ends = np.cumsum([len(t) for t in texts[a:b]])
        place, h = _anchors(b"".join(texts[a:b]), ends)
        of = np.searchsorted(ends, place, side="right")
        out.append((of + a, place - (ends - [len(t) for t in texts[a:b]])[of], h))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _grouped(values: np.ndarray, *keys: np.ndarray) -> tuple[list, ...]:
    """Distinct keys, and the values of each as bytes in the order given."""
    order = np.lexsort(keys)
    values, keys = values[order], [k[order] for k in keys]
    first = _first_of_runs(*keys)
    return *(k[first].tolist() for k in keys), [values[a:b].tobytes() for a, b in zip(first, np.append(first, len(values))[1:], strict=True)]


def shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc, anchors): for a document, hashes of anchors that another document has too; several rows for each document."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), [t or b"" for t in utf8(batch.column(1))]
            for a, b in blocks([len(t) for t in texts], BLOCK):
                of, _, h = anchors(texts[a:b])
                doc = ids[a:b][of]
                order = np.lexsort((doc, h))
                doc, h = doc[order], h[order]
                one = _first_of_runs(h, doc)
                doc, h = doc[one], h[one]
                first = _first_of_runs(h)
                n = np.diff(np.append(first, len(h)))
                inside = np.repeat(n > 1, n)  # two documents of the block have it
                own_docs, own = _grouped(h[inside], doc[inside])
                rows = [(d % buckets, -1, d, v, b"", b"") for d, v in zip(own_docs, own, strict=True)]
                lone = n == 1
                bucket, key = _bucket(h[first], buckets), h[first]
                heads = doc[first].astype("<i8")
                for k, part in parts(bucket):
                    keys, flags = pack_sorted(key[part], lone[part])
                    rows.append((k, 0, 0, keys, flags, heads[part].tobytes()))
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "kind", "doc", "keys", "lone", "docs"])

    def meet(key, group):
        doc_out, out = [], []
        keys, lone, docs = [], [], []
        for kind, doc, k, f, d in zip(*(group.column(c).to_pylist() for c in ("kind", "doc", "keys", "lone", "docs")), strict=True):
            if kind < 0:
                doc_out.append(doc)
                out.append(k)
            else:
                h, flags = unpack_sorted(k, f)
                keys.append(h)
                lone.append(flags)
                docs.append(np.frombuffer(d, dtype="<i8"))
        if keys:
            h, alone, doc = np.concatenate(keys), np.concatenate(lone), np.concatenate(docs)
            order = np.lexsort((doc, h))
            h, alone, doc = h[order], alone[order], doc[order]
            first = _first_of_runs(h)
            n = np.diff(np.append(first, len(h)))
            last = first + n - 1
            many = (np.minimum.reduceat(alone, first) == 0) | (doc[first] != doc[last])
            mine = np.repeat(many, n) & (alone == 1)
            d, v = _grouped(h[mine], doc[mine])
            doc_out += d
            out += v
        return pa.table({"doc": pa.array(doc_out, pa.int64()), "anchors": pa.array(out, pa.binary())})

    sent = map_arrow(docs, send, "bucket int, kind int, doc long, keys binary, lone binary, docs binary")
    return sent.groupBy("bucket").applyInArrow(meet, "doc long, anchors binary")


def entries_of(texts: list[bytes], of: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A row for each anchor: the suffix from there, the bytes before it in reverse (zeros
    beyond the text), and how many bytes of the text are there before it and from it on."""
    out = np.zeros((len(of), ENTRY + 2), dtype=np.uint8)
    out[:, ENTRY] = np.minimum(place, SIDE)
    begin = _first_of_runs(of)
    for a, b in zip(begin, np.append(begin, len(of))[1:], strict=True):
        text = texts[of[a]]
        padded = np.frombuffer(bytes(SIDE) + text + bytes(LENGTH), dtype=np.uint8)
        around = np.lib.stride_tricks.sliding_window_view(padded, ENTRY)[place[a:b]]
        out[a:b, :LENGTH] = around[:, SIDE:]
        out[a:b, LENGTH:ENTRY] = around[:, SIDE - 1 :: -1]
        out[a:b, ENTRY + 1] = np.minimum(len(text) - place[a:b], LENGTH)
    return out


def front_coded(strings: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted rows of bytes: shared prefixes with the row before, and the rests."""
    if not len(strings):
        return b"", b""
    lcp = np.zeros(len(strings), dtype=np.uint8)
    differ = strings[1:] != strings[:-1]
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    rest = np.arange(strings.shape[1])[None] >= lcp[:, None]
    return lcp.tobytes(), strings[rest].tobytes()


def from_front_coded(lcp: bytes, rests: bytes, width: int) -> list[bytes]:
    out, at, last = [], 0, b""
    for n in lcp:
        last = last[:n] + rests[at : at + width - n]
        at += width - n
        out.append(last)
    return out


def merged(runs: list[tuple[list[bytes], bytes]], width: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Order of all runs' strings as (run, place), and the prefix each shares with the one before.

    ``runs`` has sorted strings of one width and the prefix each shares with its
    predecessor. Every contender's shared prefix with the last winner is kept; of two
    contenders the one with the longer is less, and bytes are compared, from there on, only
    if they are equal.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    own = [r[1] for r in runs] + [b""] * (k - len(runs))
    at, sizes = [0] * k, [len(s) for s in strings]
    head = [s[0] if s else None for s in strings]
    lcp = [0 if s else -1 for s in strings]
    number = int.from_bytes

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix is then with the winner."""
        x, y = lcp[a], lcp[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0 or x == width:
            return a, b
        s, t = head[a], head[b]
        differ = number(s[x:], "big") ^ number(t[x:], "big")
        common = width - (differ.bit_length() + 7) // 8
        if s <= t:
            lcp[b] = common
            return a, b
        lcp[a] = common
        return b, a

    losers, row = [0] * k, list(range(k))
    node = k
    level = row
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            w, losers[node + i // 2] = play(level[i], level[i + 1])
            up.append(w)
        level = up
    winner = level[0]
    order, shared = [], []
    while lcp[winner] >= 0:
        place = at[winner]
        order.append((winner, place))
        shared.append(lcp[winner])
        place += 1
        at[winner] = place
        if place < sizes[winner]:
            head[winner], lcp[winner] = strings[winner][place], own[winner][place]
        else:
            lcp[winner] = -1
        node = (k + winner) // 2
        while node:
            other = losers[node]
            x, y = lcp[winner], lcp[other]
            if x < y:
                winner, losers[node] = other, winner
            elif x == y:
                winner, losers[node] = play(winner, other)
            node //= 2
    return order, shared


def runs_at(shared: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the runs in sorted order within which strings share ``depth`` bytes; ``shared`` is the prefix that each shares with the one before."""
    return np.cumsum(shared < depth)


def sorted_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and the prefix that each shares with the one before in that order."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    return order, np.frombuffer(front_coded(rows[order])[0], dtype=np.uint8)


def covered(shared: np.ndarray, before: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """[rows, SIDE + 1]: whether the string that begins j bytes before the anchor is also in a
    row with a smaller document. Rows are in merged order: ``shared`` is the prefix that each
    shares with the one before, ``before`` the bytes before its anchor in reverse, ``left`` and
    ``right`` how many bytes the text has there."""
    n = len(shared)
    out = np.zeros((n, SIDE + 1), dtype=bool)
    back, back_shared = sorted_prefixes(before)
    of_back = np.empty(n, dtype=np.int64)
    for j in range(SIDE + 1):
        rows = np.flatnonzero((left >= j) & (right >= LENGTH - j))
        if len(rows) < 2:
            continue
        of_back[back] = runs_at(back_shared, j)
        key = runs_at(shared, LENGTH - j)[rows] * np.int64(n + 1) + of_back[rows]
        order = np.argsort(key, kind="stable")  # nearly in order already
        rows, key = rows[order], key[order]
        first = _first_of_runs(key)
        least = np.repeat(np.minimum.reduceat(doc[rows], first), np.diff(np.append(first, len(key))))
        out[rows[doc[rows] > least], j] = True
    return out


def spans_of(place: np.ndarray, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, begin and end) of the bytes that each row's covered strings take up."""
    wide = np.zeros((len(cover), SIDE + 3), dtype=np.int8)
    wide[:, 1:-1] = cover[:, ::-1]  # by begin
    edge = np.diff(wide, axis=1)
    row, begin = np.nonzero(edge > 0)
    end = np.nonzero(edge < 0)[1]
    base = place[row] - SIDE
    return row, np.stack((base + begin, base + end - 1 + LENGTH), axis=1)


def covered_spans(found: DataFrame, buckets: int) -> DataFrame:
    """(doc, row, spans): byte ranges of a text that smaller documents cover; ``found`` has
    doc, text, the lists of the document's shared anchors, and row, a hash of the text that
    tells rows with one doc apart."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists, hashes = batch.column(0).to_numpy(), [t or b"" for t in utf8(batch.column(1))], batch.column(2).to_pylist(), batch.column(3).to_numpy()
            for a, b in blocks([len(t) for t in texts], BLOCK):
                part = texts[a:b]
                of, place, h = anchors(part)
                keep = np.zeros(len(of), dtype=bool)
                edges = np.searchsorted(of, np.arange(b - a + 1))
                for i, hs in enumerate(lists[a:b]):
                    if hs:
                        keep[edges[i] : edges[i + 1]] = np.isin(h[edges[i] : edges[i + 1]], np.frombuffer(b"".join(hs), dtype="<u8"))
                of, place, h = of[keep], place[keep], h[keep]
                rows = []
                if len(of):
                    text = entries_of(part, of, place)
                    doc, row, bucket = ids[a:b][of], hashes[a:b][of], _bucket(h, buckets)
                    order = np.lexsort((doc, text.view(f"S{ENTRY + 2}").ravel(), bucket))
                    text, doc, row, place, bucket = text[order], doc[order], row[order], place[order], bucket[order]
                    first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]).any(axis=1) | (bucket[1:] != bucket[:-1]))))
                    least = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
                    settled = doc > least
                    if settled.any():
                        offsets = np.arange(SIDE + 1)[None]
                        cover = (text[settled, ENTRY, None] >= offsets) & (text[settled, ENTRY + 1, None] >= LENGTH - offsets)
                        at, spans = spans_of(place[settled], cover)
                        rows += [(d % buckets, -1, d, r, v, b"", b"", b"", b"") for d, r, v in zip(*_grouped(spans.astype("<i8"), doc[settled][at], row[settled][at]), strict=True)]
                    go = ~settled
                    text, doc, row, place, bucket = text[go], doc[go], row[go], place[go], bucket[go]
                    for k, s in parts(bucket):
                        lcp, rests = front_coded(text[s])
                        rows.append((k, 0, 0, 0, lcp, zstandard.compress(rests), *(x[s].astype("<i8").tobytes() for x in (doc, row, place))))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "kind", "doc", "row", "lcp", "rests", "docs", "rows", "places"])

    def meet(key, group):
        out = [], [], []
        runs, columns = [], []
        for kind, doc, row, lcp, rests, *given in zip(*(group.column(c).to_pylist() for c in ("kind", "doc", "row", "lcp", "rests", "docs", "rows", "places")), strict=True):
            if kind < 0:
                for x, v in zip(out, (doc, row, lcp), strict=True):
                    x.append(v)
            else:
                runs.append((from_front_coded(lcp, zstandard.decompress(rests), ENTRY + 2), lcp))
                columns.append([np.frombuffer(x, dtype="<i8") for x in given])
        if runs:
            order, shared = merged(runs, ENTRY + 2)
            lcp = np.asarray(shared)
            base = np.cumsum([0, *[len(c[0]) for c in columns]])
            flat = np.asarray([base[r] + i for r, i in order])
            doc, row, place = (np.concatenate(x)[flat] for x in zip(*columns, strict=True))
            # an anchor that one entry has covers nothing; whole runs go, so what is left keeps its shared prefixes
            anchor = runs_at(lcp, ANCHOR)
            size = np.bincount(anchor)
            busy = np.flatnonzero(size[anchor] > 1)
            tails = np.frombuffer(b"".join(runs[r][0][i][LENGTH:] for r, i in (order[x] for x in busy.tolist())), dtype=np.uint8).reshape(-1, SIDE + 2)
            doc, row, place = doc[busy], row[busy], place[busy]
            cover = covered(lcp[busy], tails[:, :SIDE], tails[:, SIDE].astype(np.int64), tails[:, SIDE + 1].astype(np.int64), doc)
            at, spans = spans_of(place, cover)
            for x, v in zip(out, _grouped(spans.astype("<i8"), doc[at], row[at]), strict=True):
                x += v
        return pa.table({"doc": pa.array(out[0], pa.int64()), "row": pa.array(out[1], pa.int64()), "spans": pa.array(out[2], pa.binary())})

    sent = map_arrow(found, send, "bucket int, kind int, doc long, row long, lcp binary, rests binary, docs binary, rows binary, places binary")
    return sent.groupBy("bucket").applyInArrow(meet, "doc long, row long, spans binary")


def cut(text: bytes, spans: list[bytes] | None) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what remains."""
    if not spans:
        return 0, 0, text
    ranges = np.frombuffer(b"".join(spans), dtype="<i8").reshape(-1, 2)
    change = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(change, ranges[:, 0], 1)
    np.add.at(change, ranges[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    return int(gone.sum()), len(runs_of(gone)[0]), np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that remain) of every row of ``docs``."""
    row = F.xxhash64("text")
    nameless = row.bitwiseAND(F.lit(LAST - 1)) + F.lit(LAST)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), nameless).alias("doc"), "text", row.alias("row"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET))
    digests = own.select("doc", "row", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    first = with_least(digests, "digest", "doc", "first", max(SALTS, buckets // SALTS))
    copies = first.where("doc > first").groupBy("doc").agg(F.collect_set("row").alias("copies"))
    # the texts are exchanged once, by document, for all three uses of them
    own = own.join(copies, "doc", "left").withColumn("copy", F.coalesce(F.array_contains("copies", F.col("row")), F.lit(False))).drop("copies")
    lone = own.where("not copy")
    lists = shared_anchors(lone.select("doc", "text"), buckets).groupBy("doc").agg(F.collect_list("anchors").alias("anchors"))
    spans = covered_spans(lone.join(lists, "doc").select("doc", "text", "anchors", "row"), buckets)
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("row", "spans")).alias("spans"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column(1))]
            parts = []
            for t, s, r, copy in zip(texts, *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if copy:
                    parts.append((len(t), 1, b"") if len(t) >= LENGTH else (0, 0, t))
                else:
                    parts.append(cut(t, [x["spans"] for x in s or () if x["row"] == r]))
            ids = pa.array([None if d >= LAST else d for d in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.int64()), pa.array([p[2] for p in parts], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_arrow(own.join(spans, "doc", "left").select("doc", "text", "spans", "row", "copy"), work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_texts = remove_repeats(table(spark, sf_dir, "documents"))
    return cut_texts.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
