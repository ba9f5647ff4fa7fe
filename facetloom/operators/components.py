"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.shared import materialize


#: Parts that the rows of one node are dealt over, so that the centre of a star is no single task.
SALTS = 64


def with_least(df: DataFrame, key: str, value: str, name: str, salts: int = SALTS) -> DataFrame:
    """``df`` and ``name``, the least ``value`` of all rows with the row's ``key``.

    A key's rows are dealt over ``salts`` parts: each part is aggregated, a key's parts
    (``salts`` at most) meet, and the result goes back to each part. Rows without a key go.
    """
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    least = dealt.groupBy(key, "__salt").agg(F.min(value).alias(name))
    least = least.groupBy(key).agg(F.min(name).alias(name), F.collect_list("__salt").alias("__salts"))
    return dealt.join(least.select(key, name, F.explode("__salts").alias("__salt")), [key, "__salt"]).drop("__salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = with_least(both, "u", "v", "m").where("v > u")
    return near.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return with_least(down, "u", "v", "m").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node with an edge; the component is its least node.

    ``edges`` has two columns of one type; loops and repeats do no harm, nulls are dropped.
    Large-star and small-star steps alternate, each an aggregate and a join, until the
    edges are stars; each round is cut off in the shared folder.
    """
    a, b = edges.columns
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    now, before = materialize(now, "edges"), None
    for _ in range(rounds):
        now = materialize(_small_star(_large_star(now)).distinct(), "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
