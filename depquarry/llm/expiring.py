"""Expiring deduplication of clicks: a stateful stream whose windows close by the event-time watermark.

Each click_id has at most one open window. Its opener is the first copy; copies up to ``window`` hours
after the opener's hour are repeats, later ones close the window and open another. A copy that is over
``late`` hours older than the newest hour of earlier batches is dropped by Spark, as it lies behind the
watermark; a window whose last hour lies behind it is closed by a timeout. Both follow from the watermark
in the checkpoint, so a query that is started anew on it goes on where the last one ended. Behind the last
batch a sentinel row moves the watermark past every window.

The state is kept for blocks of 1024 neighbouring click_ids, not for single ones: a tuple with the block's
open windows, 72 bytes each. The fold goes per click_id, by hour, then hash, over all chunks that Spark
hands to a group. What is unbounded in a block is only how many different copies one click_id has in
a batch: copies that are equal in hour and hash are counted before they reach the stream, while the
batches are cut, with a partial count before the shuffle.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depquarry.llm.common import shared_path

#: Ids of a block share 54 leading bits.
BLOCK_BITS = 10
HOUR_MS = 3_600_000
#: click_id, start_hour, n_repeats, n_conflicts, conflict_crc, hash.
OPEN = "<5q32s"
#: The block of the sentinel; no click_id is in it.
NOWHERE = -(1 << 63)

#: While the query runs: a batch's rows are late by the watermark that its windows time out by, not by the one before.
SETTINGS = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.statefulOperator.allowMultiple": "false"}

WINDOWS = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash string"


@dataclass(frozen=True)
class Expiry:
    window: int = 48
    late: int = 24


def utc_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone counts as UTC whatever the session's zone is."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.unix_micros(F.concat(F.col(name).cast("string"), F.lit("Z")).cast("timestamp"))
    return F.unix_micros(name)


def fold(p: Expiry, batch: int, before: int, first: int):
    """The stateful function of the query that takes ``batch``, the next with rows after ``before``; event times count hours from ``first``."""
    deadline = lambda start: (start - first + 1 + p.window) * HOUR_MS

    def run(key, chunks, state):
        held = {w[0]: list(w[1:]) for w in struct.iter_unpack(OPEN, state.get[0])} if state.exists else {}
        done = []

        def close(click: int, at: int) -> None:
            start, repeats, conflicts, crc, digest = held.pop(click)
            done.append((click, start, at, repeats, conflicts, crc, digest.hex()))

        now = state.getCurrentWatermarkMs()
        for click in [c for c, w in held.items() if deadline(w[0]) < now]:
            close(click, before)
        if not state.hasTimedOut:
            rows = []
            for c in chunks:
                rows += zip(c["click_id"].tolist(), c["hour"].tolist(), c["hash"], c["n"].tolist())
            rows.sort()
            for click, hour, digest, n in rows:
                if not n:  # the sentinel
                    continue
                w = held.get(click)
                if w is None or hour > w[0] + p.window:
                    if w is not None:
                        close(click, batch)
                    w = held[click] = [hour, 0, 0, 0, digest]
                    n -= 1
                w[1] += n
                if digest != w[4]:
                    w[2] += n
                    w[3] += n * zlib.crc32(digest.hex().encode())
        if held:
            state.update((b"".join(struct.pack(OPEN, c, *w) for c, w in held.items()),))
            state.setTimeoutTimestamp(deadline(min(w[0] for w in held.values())))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in WINDOWS.split(", ")])

    return run


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Moves a folder; False where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(old)):
        return False
    fs.mkdirs(path(new).getParent())
    return fs.rename(path(old), path(new))


def deduplicate(copies: DataFrame, batches: int, p: Expiry = Expiry()) -> DataFrame:
    """The windows of ``copies`` (click_id long, hour long, hash binary of 32 bytes, batch int, any others), fed batch by batch.

    Returns (click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash): closed_batch is
    the batch in which, or after which, the window closed; conflicts are the repeats whose hash differs from the
    opener's; conflict_crc sums the crc32 of their hashes in hexadecimal.

    Rows in which click_id, hour, hash or batch is null belong to no window and are left out, as are those of
    batches outside [0, batches). Equal rows are repeats of one another. An empty table has no windows; a batch
    without rows starts no query, as it moves no watermark. Every call has a folder of its own with the batches,
    the checkpoint and the result.
    """
    spark, root = copies.sparkSession, shared_path(copies.sparkSession, "expiring")
    used = copies.select(F.col("batch").cast("int").alias("batch"), F.col("click_id").cast("long").alias("click_id"), F.col("hour").cast("long").alias("hour"), "hash")
    used = used.where(F.col("batch").between(0, batches - 1)).na.drop()
    used.groupBy("batch", "click_id", "hour", "hash").agg(F.count("*").alias("n")).write.partitionBy("batch").parquet(f"{root}/cut")
    columns = "click_id long, hour long, hash binary, n long"
    ends = spark.read.schema(f"{columns}, batch int").parquet(f"{root}/cut").agg(F.min("hour").alias("first"), F.max("hour").alias("last")).first()
    if ends["first"] is None:
        return spark.createDataFrame([], WINDOWS)
    first = ends["first"]
    # the sentinels: rows without copies, of which the first moves the watermark and the second lets it act
    beyond = spark.range(1).select(F.lit(0).cast("long").alias("click_id"), F.lit(ends["last"] + p.window + p.late + 1).cast("long").alias("hour"), F.lit(b"").alias("hash"), F.lit(0).cast("long").alias("n"))
    for batch in (batches, batches + 1):
        beyond.write.parquet(f"{root}/cut/batch={batch}")
    was = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        _feed(spark, root, batches, first, columns, p)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    return spark.read.schema(WINDOWS).parquet(f"{root}/windows")


def _feed(spark: SparkSession, root: str, batches: int, first: int, columns: str, p: Expiry) -> None:
    """Starts the query anew for each batch that has rows, and for the sentinels."""
    last = 0
    for batch in range(batches + 2):
        if not rename(spark, f"{root}/cut/batch={batch}", f"{root}/fed/{batch}"):
            continue
        rows = spark.readStream.schema(columns).option("recursiveFileLookup", "true").parquet(f"{root}/fed")
        # whole hours, so a millisecond keeps those that are exactly as old as is allowed
        rows = rows.withColumn("event_time", F.timestamp_seconds((F.col("hour") - first + 1) * 3600)).withWatermark("event_time", f"{p.late} hours 1 millisecond")
        rows = rows.withColumn("block", F.when(F.col("n") == 0, F.lit(NOWHERE)).otherwise(F.shiftright("click_id", BLOCK_BITS)))
        windows = rows.groupBy("block").applyInPandasWithState(fold(p, batch, batches - 1 if batch > batches else last, first), WINDOWS, "windows binary", "append", "EventTimeTimeout")
        query = windows.writeStream.format("parquet").option("path", f"{root}/windows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        last = batch if batch < batches else last


def click_copies(clicks: DataFrame, batches: int = 10) -> DataFrame:
    """(batch, click_id, hour, hash): the copies 0 to ``click_id % 3`` of every click, dealt out to batches by when they land.

    Copy j lands some hours after its own hour, both drawn from the crc32 of ``click_id:j``. Clicks without a
    click_id or arrived_at have no copies; other nulls count as empty in the hash.
    """
    micros = F.floor(utc_micros(clicks, "arrived_at") / F.lit(3_600_000_000)).cast("long")
    parts = ["client_id", "kind", F.floor(100 * F.col("value") + 0.5), utc_micros(clicks, "ts"), "props"]
    text = F.concat(*[x for part in parts for x in (F.coalesce((F.col(part) if isinstance(part, str) else part).cast("string"), F.lit("")), F.lit("|"))])
    rows = clicks.select(F.col("click_id"), micros.alias("arrived"), text.alias("text")).where("click_id is not null and arrived is not null")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.pmod("click_id", F.lit(3)).cast("int"))).alias("j"))
    c = F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string")).cast("binary"))
    rows = rows.select("click_id", "arrived", "text", "j", c.alias("c"))
    hour = F.col("arrived") + 6 * F.col("j") * (F.col("c") % 10)
    rows = rows.select("click_id", "text", "c", hour.alias("hour"), (hour + F.floor(F.col("c") / 10) % 200).alias("lands"))
    ends = rows.agg(F.min("lands").alias("lo"), F.max("lands").alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    batch = F.floor((F.col("lands") - lo) * batches / (hi - lo + 1)).cast("int")
    return rows.select(batch.alias("batch"), "click_id", "hour", F.unhex(F.sha2(F.concat("text", (F.col("c") % 3).cast("string")), 256)).alias("hash"))
