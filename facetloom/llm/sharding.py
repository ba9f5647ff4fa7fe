"""Assignment of documents to shards by a hierarchical weighted hash tree.

A tree has regions, their racks and the racks' shards. A key descends it: at each level
every child draws ``-ln(u) / weight`` with ``u`` hashed from the key and the child's name,
and the smallest draw wins. A child's share is its weight's, and raising a weight moves
keys into that child only. A shard that is added opens a region of its own, so every key
that moves at all moves into that shard.

Only DataFrame expressions are used. Numbering inside a shard is two-level: rows are
spread by hash over ``BUCKETS`` buckets of each shard, numbered there, and shifted by the
rows of the buckets before, so no task handles a whole shard.

Defined cases: a null text has size 1 and checksum 0; a null key is a key like any other;
rows that repeat get the same shard and different slots; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetloom.llm.common import table
from facetloom.shared import materialize

BUCKETS = 512
#: Shards of a rack and racks of a region in ``tree_of``.
RACK, REGION = 4, 2


@dataclass(frozen=True)
class Node:
    """A subtree; ``shard`` is set for a leaf. Its weight is the sum of its leaves'."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(x.weight for x in self.children) if self.children else self.own


def tree_of(shards: int) -> Node:
    """Regions of two racks of four shards; shards beyond a whole region open regions of their own."""
    whole = shards - shards % (RACK * REGION)
    regions = []
    for r in range(0, whole, RACK * REGION):
        racks = [Node(f"k{k}", tuple(Node(f"s{s}", shard=s) for s in range(k, k + RACK))) for k in range(r, r + RACK * REGION, RACK)]
        regions.append(Node(f"r{r}", tuple(racks)))
    regions += [Node(f"r{s}+", (Node(f"k{s}+", (Node(f"s{s}", shard=s),)),)) for s in range(whole, shards)]
    return Node("root", tuple(regions))


def grow(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own: keys move only into it."""
    region = Node(f"r{shard}+", (Node(f"k{shard}+", (Node(f"s{shard}", shard=shard, own=weight),)),))
    return Node(tree.name, (*tree.children, region))


def _levels(tree: Node) -> list[list[list[Node]]]:
    """For each level, the children of each of its nodes; nodes are numbered in this order."""
    levels, nodes = [], [tree]
    while any(n.children for n in nodes):
        levels.append([list(n.children) or [n] for n in nodes])
        nodes = [c for kids in levels[-1] for c in kids]
    return levels


def draw(key: Column, name: Column, weight: Column) -> Column:
    """A child's draw for a key: exponential with the child's weight as its rate."""
    digits = F.substring(F.md5(F.concat(key, F.lit("/"), name).cast("binary")), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))
    return -F.log(u) / weight


def descend(df: DataFrame, tree: Node, out: str) -> DataFrame:
    """Adds the shard that each row's ``key`` reaches, one level of the tree after another."""
    at = F.lit(0)
    for depth, level in enumerate(_levels(tree)):
        number, kids = 0, []
        for children in level:
            ids = range(number, number + len(children))
            kids.append(F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"), F.lit(i).alias("id")) for c, i in zip(children, ids, strict=True)]))
            number += len(children)
        draws = F.transform(F.element_at(F.array(*kids), at + 1), lambda c: F.struct(draw(F.col("key"), c["name"], c["weight"]).alias("draw"), c["id"].alias("id")))
        df = df.withColumn(f"__{out}_{depth}", F.array_min(draws)["id"])
        at = F.col(f"__{out}_{depth}")
        leaves = [c for children in level for c in children]
    return df.withColumn(out, F.element_at(F.array(*[F.lit(x.shard) for x in leaves]), at + 1))


def assign(docs: DataFrame, shards: int, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard (with one more shard) and slot of each row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    tree = tree_of(shards)
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
    )
    rows = descend(descend(rows, tree, "shard"), grow(tree, shards), "grown_shard").select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard",
        (F.conv(F.substring(F.md5(F.concat_ws("/", F.col("key"), F.col("size"), F.col("text_crc32")).cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int").alias("bucket"),
    )
    rows = materialize(rows, "shards")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    # at most shards * buckets rows: small whatever the input
    numbered = rows.withColumn("n", F.row_number().over(within)).join(F.broadcast(starts), ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("n") - 1).alias("slot"), "grown_shard")


def op10_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )

