"""Result caching: keys, expiry, what to refresh, and a read-through store that outlives its process."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TTL_S, OLD_S, STALEST = 60, 10, 2


def cache_key(query: str, max_topics: int = 40) -> str:
    return urlencode({"q": query, "max_topics": max_topics, "format": "json"})


def expired(last: Column, now: Column, ttl: int = TTL_S) -> Column:
    """Whether an entry is missing or older than its time to live."""
    return last.isNull() | (now.cast("double") - last.cast("double") > ttl)


def to_refresh(entries: DataFrame, now: Column, old: int = OLD_S, most: int = STALEST) -> DataFrame:
    """Every entry that was never filled, and of those that are old the stalest few."""
    unseen = entries.where(F.col("last_update").isNull())
    stale = entries.where(now.cast("double") - F.col("last_update").cast("double") > old).orderBy("last_update", "key").limit(most)
    return unseen.unionByName(stale)


def hashed_key(key: Column) -> Column:
    """The name under which a key's results are stored."""
    return F.sha2(key.cast("binary"), 256)


class ResultCache:
    """Query results as Parquet under a folder: ``<hash of the key>/<time in milliseconds>``.

    The folder is the index, so another process, or the same one later, finds them.
    """

    def __init__(self, spark: SparkSession, folder: str, ttl: int | None = TTL_S) -> None:
        self.spark, self.folder, self.ttl = spark, folder, ttl

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def made(self, key: str) -> tuple[float, str] | None:
        """When a key's newest result was made, and where it is; results that were not written to the end don't count."""
        top = self._path(hashlib.sha256(key.encode()).hexdigest())
        store = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(top):
            return None
        times = [int(x.getPath().getName()) for x in store.listStatus(top)]
        for ms in sorted(times, reverse=True):
            if store.exists(self._path(top.getName(), str(ms), "_SUCCESS")):
                return ms / 1000, str(self._path(top.getName(), str(ms)))
        return None

    def call(self, key: str, make: Callable[[], DataFrame], now: float, force: bool = False) -> DataFrame:
        """The stored result, or a new one if it is missing, expired or to be made anew; ``ttl`` None never expires."""
        found = self.made(key)
        if force or found is None or self.ttl is not None and now - found[0] > self.ttl:
            path = str(self._path(hashlib.sha256(key.encode()).hexdigest(), str(int(now * 1000))))
            make().write.mode("overwrite").parquet(path)
        else:
            path = found[1]
        return self.spark.read.parquet(path)


def prebake(cache: ResultCache, queries: list[str], make: Callable[[str, int], DataFrame], now: float, sizes: tuple[int, ...] = (10, 40)) -> list[str]:
    """One round of refreshing: returns the keys made. A query that fails is left for the next round."""
    keys = {cache_key(q, n): (q, n) for q in queries for n in sizes}
    rows = [(k, (cache.made(k) or (None,))[0]) for k in keys]
    entries = cache.spark.createDataFrame(rows, "key string, last_update double")
    done = []
    for r in to_refresh(entries, F.lit(now)).collect():  # a row for each listed query
        try:
            cache.call(r.key, lambda q=keys[r.key]: make(*q), now, force=True)
            done.append(r.key)
        except Exception as error:  # noqa: BLE001
            print(f"{r.key}: {error}")
    return done
