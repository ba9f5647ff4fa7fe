"""Near-duplicates of a given Jaccard similarity by SimHash, with candidates from pigeonring filtering.

Two texts link when their sets of ``SHINGLE``-word shingles have a Jaccard similarity of
``LEAST`` or more. At 0.8 the 64 bits of a plain SimHash differ in ten places on average
and up to twenty, as those of many unrelated texts do, so this fingerprint is wider and an
edit moves little of it: shingles are dealt by their hash over ``M`` classes, and a class's
``VOTES`` least hashes vote on the ``WIDTH`` bits of its own segment. The segments stand in
a ring. Texts that share the shingles of a class agree in its segment, and every pair of
texts that agrees in one meets there: a chain of segments that starts at that one has, at
each length l, a cumulative difference of l * TAU / M at most, or the pair is dropped before
the whole distance is taken. Every link is then decided on the whole sets.

At similarity 0.8 a class's votes are the same in both texts with a probability of
0.8^VOTES, so a pair meets nowhere with 1 - 0.8^4 to the power of M: 3 in 100,000. Its
distance is 78 bits on average with a deviation of 16, where TAU is 160 and unrelated texts
are beyond 250; closer pairs are lost less often still.

Equal sets count once. Sets that share a key with another are written to the shared folder,
once each, and read where candidates meet; ``CACHE`` bytes of sets are held at most. Rows
under one key are compared while they stream past; those that are linked already are not
compared again. A key with more than ``HEAVY`` sets is cut into blocks, and each pair of
blocks is a piece of work of its own. Components are then found by star contraction.

Defined cases: a text of fewer words than a shingle is one shingle; null and empty texts have
no shingles and link with one another only; rows that repeat are in one component; rows with
a null doc_id come after all others; equal doc_ids in one component leave one row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom.llm.common import map_arrow, utf8
from facetloom.operators.components import connected_components
from facetloom.shared import materialize, new_path

SHINGLE, LEAST, SEED = 5, 0.8, 42
#: Segments of the ring, hashes that vote on each, bits of each, and the distance within which texts may link.
M, VOTES, WIDTH, TAU = 20, 4, 32, 160
LONGS = M * WIDTH // 64
HEAVY = 2048
#: Rows that a worker compares at once, bytes of sets and open files that it holds.
CHUNK, CACHE, FILES = 100_000, 64 << 20, 64

#: Where the hashes of each class begin.
_EDGES = np.asarray([-(-(k << 64) // M) for k in range(1, M)], dtype=np.uint64)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) > size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64))


def ring(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments of a set's fingerprint, and which classes have a shingle; hashes are in order."""
    begin = np.concatenate(([0], np.searchsorted(hashes, _EDGES)))
    size = np.diff(np.append(begin, len(hashes)))
    voting = np.arange(VOTES) < size[:, None]
    x = np.zeros((M, VOTES), dtype=np.uint64)
    x[voting] = hashes[(begin[:, None] + np.arange(VOTES))[voting]]
    x *= np.uint64(0x9E3779B97F4A7C15)  # the hashes of a class begin alike
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    bits = np.unpackbits(x.astype("<u4").view(np.uint8).reshape(M, VOTES, 4), axis=2, bitorder="little").astype(np.int64)
    votes = (bits * voting[:, :, None]).sum(axis=1)
    return np.packbits(2 * votes > np.minimum(size, VOTES)[:, None], axis=1, bitorder="little").view("<u4").ravel(), size > 0


def ring_keys(segments: np.ndarray, some: np.ndarray) -> list[int]:
    """A key for each segment whose class has a shingle."""
    return (np.flatnonzero(some) << 32 | segments[some].astype(np.int64)).tolist()


def within_budgets(x: np.ndarray, start: int) -> np.ndarray:
    """Rows of ``x`` (differences of segments) whose chain from segment ``start`` keeps its budgets to the end of the ring."""
    rows, total = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for length in range(1, M + 1):
        total = total + np.bitwise_count(x[rows, (start + length - 1) % M])
        keep = total * M <= length * TAU
        if not keep.all():
            rows, total = rows[keep], total[keep]
        if not len(rows):
            break
    return rows


def sketched(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` (with a column text), and of each row's set a digest (__set), the size (__n), the fingerprint (__bits) and __keys."""
    at = docs.columns.index("text")
    fields = [T.StructField("__set", T.StringType()), T.StructField("__n", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("__bits", "__keys"))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in utf8(batch.column(at)):
                s = shingles(text, size)
                segments, some = ring(s)
                found.append((hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest(), len(s), segments.view("<i8").tolist(), ring_keys(segments, some)))
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(f.name for f in fields)])

    return map_arrow(docs, work, T.StructType([*docs.schema.fields, *fields]))


def stored(rows: DataFrame, uri: str, size: int = SHINGLE) -> DataFrame:
    """(id, file, at) for rows (id, text), whose sets are written to files in the folder ``uri``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path)
        name, done = uuid.uuid4().int >> 65, 0  # another for a task that is run again
        with store.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                places = []
                for text in utf8(batch.column(1)):
                    s = shingles(text, size)
                    out.write(s.astype("<u8").tobytes())
                    places.append(done)
                    done += len(s)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(places), pa.int64()), pa.array(places, pa.int64())], names=["id", "file", "at"])

    return map_arrow(rows, work, "id long, file long, at long")


class Sets:
    """Sets read from the shared folder."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        self.file = lru_cache(FILES)(lambda name: store.open_input_file(f"{path}/{name}"))
        self.held: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
        self.bytes = 0

    def __call__(self, file: int, at: int, n: int) -> np.ndarray:
        found = self.held.pop((file, at), None)
        if found is None:
            found = np.frombuffer(self.file(file).read_at(8 * n, 8 * at), dtype="<u8")
            self.bytes += found.nbytes
        self.held[file, at] = found
        while self.bytes > CACHE and len(self.held) > 1:
            self.bytes -= self.held.popitem(last=False)[1].nbytes
        return found


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets in order have at least that Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common >= least * (len(a) + len(b) - common) - 1e-9


def links_of(start: int, rows: np.ndarray, fetch: Callable[[int, int, int], np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between the sets of one key (of segment ``start``) and
    cell; rows are id, file, at, n and the fingerprint, by n."""
    u, v = [], []
    label, n, segments = np.arange(len(rows)), rows[:, 3], np.ascontiguousarray(rows[:, 4:]).view("<u4")
    for i in range(1, len(rows)):
        lo = int(np.searchsorted(n[:i], least * n[i] - 1e-9))
        near = lo + within_budgets(segments[lo:i] ^ segments[i], start)
        while len(near):
            j, near = near[0], near[1:]
            if similar(fetch(*rows[i, 1:4].tolist()), fetch(*rows[j, 1:4].tolist()), least):
                u.append(int(rows[i, 0]))
                v.append(int(rows[j, 0]))
                label[label == label[j]] = label[i]
                near = near[label[near] != label[i]]
    return u, v


COLUMNS = ["key", "cell", "id", "file", "at", "n", *(f"b{i}" for i in range(LONGS))]


def link_edges(sets: DataFrame, shared: DataFrame, uri: str, least: float = LEAST, heavy: int = HEAVY) -> DataFrame:
    """Edges (u, v) whose components are those of all links between distinct sets: rows id, file, at, n and bits; ``shared`` has their keys (key, id)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch, held = Sets(uri), np.empty((0, len(COLUMNS)), dtype=np.int64)

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            u, v = [], []
            edge = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            begin, end = np.append(0, edge), np.append(edge, len(rows))
            for a, b in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
                for out, more in zip((u, v), links_of(int(rows[a, 0]) >> 32, rows[a:b, 2:], fetch, least), strict=True):
                    out += more
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        waiting, count = [], 0
        for batch in batches:
            waiting.append(np.stack([batch.column(i).to_numpy() for i in range(len(COLUMNS))], axis=1))
            count += batch.num_rows
            if count >= CHUNK:  # the group that may go on in the next batch waits
                held = np.concatenate((held, *waiting))
                cut = len(held) - int((held[::-1, :2] == held[-1, :2]).all(axis=1).argmin()) if (held[:, :2] != held[-1, :2]).any() else 0
                if cut:
                    yield emit(held[:cut])
                held, waiting, count = held[cut:], [], 0
        held = np.concatenate((held, *waiting))
        if len(held):
            yield emit(held)

    sizes = shared.groupBy("key").count()
    many = materialize(sizes.where(F.col("count") > heavy).select("key", F.ceil(F.col("count") / heavy).cast("int").alias("parts")), "heavy")
    keyed = shared.join(sets.select("id", "file", "at", "n", *[F.col("bits")[i].alias(f"b{i}") for i in range(LONGS)]), "id")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    cells = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.least(p, own).cast("long") * F.col("parts") + F.greatest(p, own))
    )
    work = keyed.join(many, "key", "left").withColumn("cell", F.explode(cells)).select(*COLUMNS)
    work = work.repartition("key", "cell").sortWithinPartitions("key", "cell", "n")
    return map_arrow(work, compare, "u long, v long")


def firsts(docs: DataFrame, keep: list[str], size: int = SHINGLE, least: float = LEAST, heavy: int = HEAVY) -> DataFrame:
    """The columns ``keep`` of one row of each component of ``docs``: the one with the least doc_id."""
    uri = new_path(docs.sparkSession, "sets")
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    columns = list(dict.fromkeys([*keep, "text"]))
    rows = sketched(docs.select(*columns, F.col("doc_id").alias("__id")), size).withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows.select(*columns, *(c for c in rows.columns if c.startswith("__"))), "sketches")
    one = F.struct(F.col("__n").alias("n"), F.col("__bits").alias("bits"), F.col("__keys").alias("keys"))
    sets = materialize(rows.groupBy("__set").agg(F.min(order).alias("least"), F.min_by(one, order).alias("one")).select("least", F.col("least.row").alias("id"), "one.*"), "distinct-sets")
    keyed = sets.select("id", F.explode("keys").alias("key"))
    shared = materialize(keyed.join(keyed.groupBy("key").count().where("count > 1").select("key"), "key").select("key", "id"), "shared-keys")
    met = rows.select(F.col("__row").alias("id"), "text").join(shared.select("id").distinct(), "id", "left_semi")
    places = materialize(stored(met.select("id", "text"), uri, size), "places")
    label = connected_components(link_edges(sets.select("id", "n", "bits").join(places, "id"), shared, uri, least, heavy))
    named = sets.select("id", "least").join(label.withColumnRenamed("node", "id"), "id", "left")
    best = named.groupBy(F.coalesce("component", "id")).agg(F.min("least").alias("least"))
    return rows.join(best.select(F.col("least.row").alias("__row")), "__row", "left_semi").select(*keep)
