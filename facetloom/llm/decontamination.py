"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items.

A text is normalised to its words: A-Z lower-cased, every other character than
digits, letters and non-ASCII ones a gap. The items' windows of ``WINDOW`` words (an item
of fewer words is one window) are the automaton's patterns, and each text is scanned once,
whatever the number of items; hits are mapped back to words and to offsets in the original.

The automaton is broadcast, so its size is bounded: items are taken in blocks of
``BLOCK_CHARS`` characters, one pass over the texts for each block. One block holds
thousands of items; more blocks are the way for larger sets, nothing is left out.

Defined cases: a null or empty text has no words, an item without words no windows; an
item whose id is null hits words but is not counted; items that share an id count once;
documents that repeat get a row each; without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom.llm.common import code_points, map_arrow, table, utf8
from facetloom.shared import materialize

WINDOW = 8
BLOCK_CHARS = 1 << 20
CONTAMINATED = 2

#: A-Z lower-cased; 0-9, a-z and the bytes of non-ASCII characters kept; all else a space.
_GAPS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_GAPS).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    """A text's windows, each as its words between single spaces, with a space at both ends."""
    return {b" %b " % b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def patterns_of(items: list[tuple[str | None, str | None]], size: int = WINDOW) -> dict[bytes, tuple[int, list[str]]]:
    """Each window's number of words and the ids of the items that have it."""
    out: dict[bytes, tuple[int, list[str]]] = {}
    for item_id, text in items:
        for w in windows_of(words_of(None if text is None else text.encode()), size):
            ids = out.setdefault(w, (w.count(b" ") - 1, []))[1]
            if item_id is not None:
                ids.append(item_id)
    return out


class Scanner:
    """The automaton over the patterns of a block of items."""

    def __init__(self, patterns: dict[bytes, tuple[int, list[str]]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for pattern, found in patterns.items():
            self.automaton.add_word(pattern.decode("latin-1"), found)
        self.any = bool(patterns)
        if self.any:
            self.automaton.make_automaton()

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words are inside a window's occurrence, and the items that occur."""
        if not (self.any and words):
            return None, set()
        found = list(self.automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not found:
            return None, set()
        ends = np.cumsum([len(w) + 1 for w in words])
        change = np.zeros(len(words) + 1, dtype=np.int64)
        last = np.searchsorted(ends, [end for end, _ in found]) + 1
        np.add.at(change, last, -1)
        np.add.at(change, last - [n for _, (n, _) in found], 1)
        return np.cumsum(change[:-1]) > 0, {i for _, (_, ids) in found for i in ids}


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def spans_of(text: bytes, first: np.ndarray, last: np.ndarray) -> list[dict[str, int]]:
    """Runs of words as offsets of code points in the original."""
    begins, ends = runs(np.frombuffer(text.translate(_GAPS), dtype=np.uint8) != 32)
    at = code_points(text, np.stack((begins[first], ends[last - 1])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(*at, strict=True)]


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("hit_runs", T.ArrayType(T.IntegerType())),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
])
_ARROW = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` (with a column text) and, in a struct ``found``, n_words, n_hit, item_ids
    (sorted as strings), hit_runs (word numbers) and hit_spans (code points)."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // block_chars))
    found = T.StructField("found", _FOUND)
    schema = T.StructType([*docs.schema.fields, found])
    n_own = len(docs.schema.fields)
    kind = pa.struct([(f.name, t) for f, t in zip(_FOUND.fields, _ARROW, strict=True)])
    text_at = docs.columns.index("text")
    for part in range(parts):
        block = items.where(F.pmod(F.hash("item_id", "text"), F.lit(parts)) == part).collect()  # about block_chars
        patterns = spark.sparkContext.broadcast(patterns_of([tuple(r) for r in block], window))

        def search(batches: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(patterns.value)
            for batch in batches:
                before = batch.column(n_own).to_pylist() if batch.num_columns > n_own else [None] * batch.num_rows
                out = []
                for text, old in zip(utf8(batch.column(text_at)), before, strict=True):
                    words = words_of(text)
                    flags, ids = scanner(words)
                    if old and old["hit_runs"]:
                        flags = np.zeros(len(words), dtype=bool) if flags is None else flags
                        for a, b in zip(old["hit_runs"][::2], old["hit_runs"][1::2], strict=True):
                            flags[a:b] = True
                    ids |= set(old["item_ids"]) if old else set()
                    first, last = runs(flags) if flags is not None else (np.empty(0, int),) * 2
                    out.append({"n_words": len(words), "n_hit": int((last - first).sum()), "item_ids": sorted(ids), "hit_runs": np.stack((first, last), axis=1).ravel().tolist(), "hit_spans": spans_of(text, first, last) if len(first) else []})
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_own], pa.array(out, kind)], names=[*batch.schema.names[:n_own], "found"])

        docs = map_arrow(docs if part < 2 else materialize(docs, "scanned"), search, schema)
    return docs


def op1_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.col("found.item_ids")
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(ids) >= CONTAMINATED).alias("contaminated"),
    )


_WORDS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, greatest(1, least(len(w), {WINDOW})) AS n, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (win, n)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= {CONTAMINATED} AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
