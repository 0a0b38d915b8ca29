"""The assurance log as a stream: new files of JSON lines, counted by event and time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depquarry.sources.ledger import decoded
from depquarry.streaming import sinks


def stream_ledger(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Decoded lines of the files that come to a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).withColumnRenamed("value", "raw")
    return decoded(lines.where("raw <> ''"))


def event_counts(entries: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event, n) per tumbling window; entries later than the watermark are left out, faults too."""
    w = entries.where("ts is not null").withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event", "n")


def run_to_table(counts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Counts all that is there now into a table of windows that batches replace, then stops; read it by :func:`counted`.

    A batch writes only the windows that it changed, so the table is kept up without passing whole through the driver.
    """

    def put(df: DataFrame, batch: int) -> None:
        sinks.replace_batch(df, df, ["start", "event"], folder, batch)

    return sinks.run(counts, put, checkpoint, "update")


def counted(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of a table kept by :func:`run_to_table`."""
    return sinks.latest(spark, folder, "start timestamp, event string, n long, gone boolean", ["start", "event"])
