"""Helpers that the corpus operators share: shared folders, tables, ordered buckets, files."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="depquarry-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_paths: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; :func:`delete_written` deletes what was put there."""
    _paths.append(f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


@contextmanager
def passing_shuffles(spark: SparkSession):
    """Has Spark delete the shuffle files of each query that is begun inside as soon as it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: ``df`` as a Parquet table in the shared folder, read again with the same schema; what was shuffled for it is deleted."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with passing_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_written(spark: SparkSession) -> None:
    """Deletes the tables and files that this driver's operators wrote to the shared folder; results not yet read go with them."""
    jvm = spark.sparkContext._jvm
    while _paths:
        p = jvm.org.apache.hadoop.fs.Path(_paths.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def order_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending splits of a numeric key into ranges of about equal row counts.

    Only the key column is read, and only the splits reach the driver: their number follows the
    number of partitions asked for, not the rows.
    """
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(key, at, 10_000).alias("q")).first()["q"]
    return sorted(set(got or []))


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are below or at ``key``, by a native binary search; null keys: 0."""
    if not bounds:
        return F.lit(0)
    lit, steps = F.array(*[F.lit(b) for b in bounds]), []
    step = 1
    while step <= len(bounds):
        steps.append(step)
        step *= 2
    n = len(bounds)

    def probe(acc: Column, s: Column) -> Column:
        to = acc + s
        return F.when((to <= n) & (F.get(lit, to - 1) <= key), to).otherwise(acc)

    return F.when(key.isNull(), F.lit(0)).otherwise(F.aggregate(F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0), probe))


def small_batches(df: DataFrame, rows: int = 1000, size: int = 16 << 20) -> None:
    """Has the session hand at most ``rows`` rows and about ``size`` bytes to Python at once, as texts may be long.

    So does the reader of Parquet files, whose batches are else of 4096 texts of any length. Spark reads the
    settings when it plans a frame, so they stay for the session; smaller ones are left as they are. Results
    don't depend on them.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size), ("spark.sql.parquet.columnarReaderBatchSize", 512)):
        now = re.fullmatch(r"(\d+)([kmgt]?)b?", conf.get(key).lower())
        if not now or not 0 < int(now[1]) << 10 * " kmgt".index(now[2] or " ") <= most:
            conf.set(key, str(most))


# ---- in the tasks -----------------------------------------------------------------------------------


def sliced(batches, rows: int = 1000):
    """Record batches of at most ``rows`` rows; after the last, memory that is free goes back to the system.

    A worker serves many tasks, so what one leaves behind would stand beside what the next needs.
    """
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    release()


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


# ---- files below the shared folder, from the executors -------------------------------------------


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI; plain paths and file: URIs are local."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path or uri
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, chunks) -> int:
    """Writes a file under a temporary name, then moves it in place; returns its length.

    A task that is repeated writes a file of its own, so a lost executor leaves no half file.
    """
    files, path = filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with files.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    files.move(part, path)
    return size
