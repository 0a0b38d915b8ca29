"""Exactly-once sinks: appends keyed by content hash, upserts, and an index kept up for the keys that a batch touched.

Tables here are folders of generations: a batch writes what it adds, or the partitions that it changes, under
its own number, and the generation is named by an empty marker last. A batch that is replayed, as after a
crash between the write and the checkpoint, finds its own marker and changes nothing; one that died halfway
has none, and is written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depquarry.functions.text import canonical_hash
from depquarry.operators.dealing import dealt


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def done(spark: SparkSession, folder: str, batch: int) -> bool:
    p, fs = _fs(spark, f"{folder}/_done/{batch}")
    return fs.exists(p)


def commit(df: DataFrame, folder: str, batch: int) -> bool:
    """Writes ``df`` as the generation of a batch; False, and nothing written, where that is committed."""
    if done(df.sparkSession, folder, batch):
        return False
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    p, fs = _fs(df.sparkSession, f"{folder}/_done/{batch}")
    fs.create(p, True).close()
    return True


def batches(spark: SparkSession, folder: str) -> list[int]:
    """The committed batches of a folder, in order."""
    p, fs = _fs(spark, f"{folder}/_done")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(p)) if fs.exists(p) else []


def committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All committed rows of a folder, with the batch that wrote them."""
    paths = [f"{folder}/batch={b}" for b in batches(spark, folder)]
    if not paths:
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").option("basePath", folder).parquet(*paths)


def append_batch(folder: str, schema: str, row: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends rows whose content hash is not there yet, each content once, with ``hash``.

    The same content in two batches is the first one's; in one batch, equal rows are one.
    """

    def put(df: DataFrame, batch: int) -> None:
        if done(df.sparkSession, folder, batch):
            return
        there = committed(df.sparkSession, folder, f"{schema}, hash string").select("hash")
        n = df.count() + there.count()
        new = dealt(df.withColumn("hash", canonical_hash(row())), ["hash"], n).dropDuplicates(["hash"])
        commit(new.join(dealt(there, ["hash"], n), "hash", "left_anti"), folder, batch)

    return put


def latest(spark: SparkSession, folder: str, schema: str, keys: list[str]) -> DataFrame:
    """The rows of the last batch that touched each of ``keys``: what stands in a table kept up by :func:`replace_batch`."""
    w = Window.partitionBy(*keys)
    x = committed(spark, folder, schema)
    x = dealt(x, keys, x.count())
    return x.withColumn("_b", F.max("batch").over(w)).where("batch = _b and not gone").drop("_b", "batch", "gone")


def replace_batch(df: DataFrame, touched: DataFrame, keys: list[str], folder: str, batch: int) -> bool:
    """Makes ``df`` all that the table says of the keys in ``touched``; keys without a row in ``df`` are cleared.

    A cleared key gets a row marked ``gone``, so the clearing is remembered; other keys are not read or written.
    """
    there = df.withColumn("gone", F.lit(False))
    cleared = touched.select(*keys).distinct().join(df.select(*keys), keys, "left_anti").withColumn("gone", F.lit(True))
    return commit(there.unionByName(cleared, allowMissingColumns=True), folder, batch)


def index_batch(records: str, record_schema: str, index: str, frame: list[str], row: Callable[[], Column], ranking: Callable[[], list[Column]], ids: Column) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends records by content hash, then makes the index follow the served record of each touched frame.

    ``frame`` are the columns of a frame of analysis; of all its records, ``ranking`` (over their columns, hash
    among them) serves one, and ``ids`` (an array of strings) of that one are the frame's rows in the index. So a
    later all-clear takes back what an earlier scan put there, and only the batch's frames are composed again.
    """
    put = append_batch(records, record_schema, row)

    def reconcile(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        put(df, batch)
        if done(spark, index, batch):
            return
        known = committed(spark, records, f"{record_schema}, hash string")
        n = known.count()
        touched = dealt(df.select(*frame), frame, n).distinct()
        w = Window.partitionBy(*frame).orderBy(*ranking())
        served = dealt(known, frame, n).join(touched, frame, "left_semi").withColumn("_n", F.row_number().over(w)).where("_n = 1")
        # one row a frame, so its own ids need no other rows to be told apart, nor is what it clears looked for
        one = touched.join(served.select(*frame, F.array_distinct(ids).alias("_ids")), frame, "left")
        commit(one.select(*frame, F.explode_outer("_ids").alias("finding_id"), (F.coalesce(F.size("_ids"), F.lit(0)) < 1).alias("gone")), index, batch)

    return reconcile


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Feeds all that is there to ``each``, then stops; started again on the checkpoint, it goes on from there."""
    return stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
