"""Near-duplicates by SimHash, with candidates from pigeonring filtering.

A fingerprint is 64 bits, the majority over the XXH64 of a text's word shingles. Two
fingerprints link when ``TAU`` bits or fewer differ. Its ``M`` segments stand in a ring.
If the total difference is at most TAU, some chain of consecutive segments has, at each
length l, a cumulative difference of at most l * TAU / M. With TAU = 4 and M = 5 the
chain's first segment is equal and the second differs in one bit at most, so one of the
second's halves is equal too. A fingerprint is therefore filed under ten keys: a segment and
a half of the next. Pairs under one key must keep within the budgets of chain lengths 2, 3
and 4 before the whole distance is taken.

Texts with one fingerprint count once. Rows under one key are compared while they stream
past in key order; a key with more than ``HEAVY`` fingerprints is cut into blocks, and each
pair of blocks is a piece of work of its own. What leaves a piece is a spanning forest of
its links, never the pairs. Components are then found by star contraction.

Defined cases: a text of fewer words than a shingle is one shingle; null and empty texts
have the fingerprint zero and link like others; a null doc_id is never a component's id
unless the component has no other; rows that repeat are in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom.llm.common import map_arrow, table, utf8
from facetloom.operators.components import SALTS, connected_components, with_least
from facetloom.shared import materialize

SHINGLE, SEED = 4, 42
TAU, M = 4, 5
OFFSETS, WIDTHS = (0, 13, 26, 39, 52), (13, 13, 13, 13, 12)
HALF = 7
HEAVY = 2048
#: Rows that a worker compares at once, and links that it holds before it joins them.
CHUNK, LINKS = 200_000, 1_000_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (with a column text) and ``fp``, the fingerprint as a signed long."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in utf8(batch.column(at))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=[*batch.schema.names, "fp"])

    return map_arrow(docs, work, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def _segment(i: int) -> Column:
    return F.shiftrightunsigned("fp", OFFSETS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def chain_keys() -> Column:
    """The ten keys of ``fp``: a chain's first segment and a half of its second."""
    out = []
    for i in range(M):
        first, second = F.shiftleft(_segment(i), HALF), _segment((i + 1) % M)
        for h, half in enumerate((second.bitwiseAND(F.lit((1 << HALF) - 1)), F.shiftrightunsigned(second, HALF))):
            out.append(F.lit((2 * i + h) << 20).cast("long") + first + half)
    return F.array(*out)


def within_budgets(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places in ``x`` (differences of fingerprints) whose chain from segment ``start`` keeps its budgets to the end."""
    at, total = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    offsets = np.asarray(OFFSETS, dtype=np.uint64)
    masks = np.asarray([(1 << w) - 1 for w in WIDTHS], dtype=np.uint64)
    for length in range(1, M + 1):
        segment = (start[at] + length - 1) % M
        total = total + np.bitwise_count(x[at] >> offsets[segment] & masks[segment])
        keep = total * M <= length * TAU
        at, total = at[keep], total[keep]
    return at


class Forest:
    """Least-label components of the links among a chunk's fingerprints."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > LINKS:
            self.join()

    def join(self) -> None:
        if not self.held:
            return
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        self.a, self.b, self.held = [], [], 0
        while True:
            la, lb = self.label[a], self.label[b]
            open_ = la != lb
            if not open_.any():
                return
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def links_of(key: np.ndarray, cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints of one key and cell; rows are in their order."""
    distinct, place = np.unique(fp, return_inverse=True)
    forest, start = Forest(len(distinct)), key >> 21
    same = np.arange(len(fp) - 1)
    step = 1
    while len(same):
        same = same[same + step < len(fp)]
        same = same[(key[same] == key[same + step]) & (cell[same] == cell[same + step])]
        x = fp[same] ^ fp[same + step]
        linked = same[within_budgets(x, start[same])]
        if len(linked):
            forest.add(place[linked], place[linked + step])
        step += 1
    forest.join()
    moved = np.flatnonzero(forest.label != np.arange(len(distinct)))
    return distinct[moved], distinct[forest.label[moved]]


def _stream_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def emit(last: bool):
        nonlocal held, rows
        if not held:
            return None
        key, cell, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        end = len(key)
        if not last:  # the group that may go on in the next batch waits
            end = int(np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))[-1])
        held = [(key[end:], cell[end:], fp[end:])]
        rows = len(key) - end
        u, v = links_of(key[:end], cell[:end], fp[:end].view(np.uint64)) if end else (np.empty(0, np.uint64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
        rows += batch.num_rows
        if rows >= CHUNK:
            yield emit(False)
    if (out := emit(True)) is not None:
        yield out


def link_edges(fps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Edges (u, v) whose components are those of all links between distinct fingerprints ``fp``."""
    keyed = fps.select("fp", F.explode(chain_keys()).alias("key"))
    many = materialize(keyed.groupBy("key").count().where(F.col("count") > heavy).select("key", F.ceil(F.col("count") / heavy).cast("int").alias("parts")), "heavy")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.least(p, own).cast("long") * F.col("parts") + F.greatest(p, own))
    )
    work = keyed.join(many, "key", "left").select("key", F.explode(cells).alias("cell"), "fp")
    work = work.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return map_arrow(work, _stream_links, "u long, v long")


def components(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` of ``docs``, with ``fp``, ``component_id`` (the least doc_id
    reachable), and ``first``, true for one row of each component."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    columns = list(dict.fromkeys(["doc_id", *keep, "text"]))
    rows = fingerprints(docs.select(*columns), shingle).select(*dict.fromkeys(["doc_id", *keep]), "fp", F.monotonically_increasing_id().alias("__row"))
    rows = materialize(rows.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS))), "fingerprints")
    # the rows of one fingerprint are dealt over SALTS parts, here and where they get their component
    dealt = rows.groupBy("fp", "__salt").agg(F.min(order).alias("least"))
    fps = materialize(dealt.groupBy("fp").agg(F.min("least").alias("least"), F.collect_list("__salt").alias("__salts")), "distinct-fingerprints")
    label = connected_components(link_edges(fps.select("fp")))
    named = fps.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "__salts", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "labels")
    found = with_least(named, "component", "least", "best")
    found = found.select("fp", F.explode("__salts").alias("__salt"), F.col("best.id").alias("component_id"), F.col("best.row").alias("__first"))
    return rows.join(found, ["fp", "__salt"]).select(*keep, "fp", "component_id", (F.col("__row") == F.col("__first")).alias("first"))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
