"""Tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. Writing an intermediate result there cuts
lineage: a lost executor costs a reread, and readers see exact file sizes, so Catalyst
broadcasts such a table only when its measured size is under the session's threshold.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one on a local master where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='facetloom-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/facetloom/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run within have their result in the shared folder: what they exchanged is deleted when they end, not whenever the JVM collects its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with passing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete every table that ``materialize`` left in the shared folder."""
    discard(spark, f"{shared_dir(spark)}/facetloom")


def discard(spark: SparkSession, *uris: str) -> None:
    """Delete folders of the shared folder that nothing reads again."""
    jvm = spark.sparkContext._jvm
    for uri in uris:
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_array(uri: str, array: np.ndarray) -> None:
    """Write an array to the shared folder: under another name first, so that a task that is run twice leaves one whole file."""
    import os
    import uuid

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path))
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).view(np.uint8).data)
    store.move(part, path)


def map_array(uri: str, dtype: str) -> np.ndarray:
    """A memory-mapped array of the shared folder; what a store without files has is fetched
    into a file without a name, which goes when its mapping does."""
    import os
    import tempfile

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype=dtype)
    with tempfile.TemporaryFile() as own, store.open_input_stream(path) as source:
        while chunk := source.read(1 << 20):
            own.write(chunk)
        return np.memmap(own, dtype=dtype, mode="r") if own.tell() else np.empty(0, dtype=dtype)
