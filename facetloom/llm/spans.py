"""Digests of the spans that a scan found, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: start, rank (place of the kind in the list of kinds), end
SPAN = "struct<start:int,rank:int,end:int>"


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["rank"] == rank)).cast("long")


def digests(spans: Column, kinds: list[str], base: int) -> list[Column]:
    """n_<kind> of the first ``base`` kinds, base_sha256 over their spans, and all spans."""
    mine = F.filter(spans, lambda x: x["rank"] < base)
    return [
        *[count(spans, i).alias(f"n_{k}") for i, k in enumerate(kinds[:base])],
        F.sha2(joined(mine, kinds).cast("binary"), 256).alias("base_sha256"),
        joined(spans, kinds).alias("spans"),
    ]
