"""The assurance log: append-only JSON lines; a line that can't be read is a fault, not nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depquarry.operators.rollup import fault_bounds

RESERVED = ("event", "ts")
MODULE_KEYS = ("module_path", "path", "module")
VERSION_KEYS = ("module_version", "version")


def decoded(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """``lines`` with event, ts, payload (map) and fault: the payload object, or the flat object without the reserved keys."""
    flat = F.from_json(F.col(raw), "map<string,string>")
    ok = flat.isNotNull() & (F.size(flat) > 0)
    out = lines.withColumn("_flat", F.when(ok, flat))
    inner = F.from_json(F.col("_flat")["payload"], "map<string,string>")
    rest = F.map_filter(F.col("_flat"), lambda k, _: ~k.isin(*RESERVED))
    out = out.withColumn("event", F.col("_flat")["event"]).withColumn("ts", F.try_to_timestamp(F.col("_flat")["ts"]))
    return out.withColumn("payload", F.coalesce(inner, rest)).withColumn("fault", F.col("_flat").isNull()).drop("_flat")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a JSON-lines file in order, decoded, with the times around each fault. ``path`` names one file.

    The high bits of a line's number are those of the split that it was read from: blocks of the order. Only the
    splits of one file are in such an order, so a folder or a pattern of names is refused.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(hadoop):
        raise ValueError(f"{path} is no file: the lines of several files have no order")
    text = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).withColumnRenamed("value", "raw")
    return fault_bounds(decoded(text.where("raw <> ''")), "line", "ts", block=F.shiftright("line", 33))


def matches(since: str | None = None, until: str | None = None, event: str | None = None, module: str | None = None, version: str | None = None) -> Column:
    """Inclusive times, the event, the module under any of its keys; a version must match only where one is stated."""
    out = F.lit(True)
    if since:
        out &= F.col("ts") >= F.lit(since).cast("timestamp")
    if until:
        out &= F.col("ts") <= F.lit(until).cast("timestamp")
    if event:
        out &= F.col("event") == event
    if module:
        out &= F.array_contains(F.array(*[F.col("payload")[k] for k in MODULE_KEYS]), module)
    if version:
        stated = F.coalesce(*[F.col("payload")[k] for k in VERSION_KEYS])
        out &= stated.isNull() | (stated == version)
    return F.coalesce(out, F.lit(False))


def report(lines: DataFrame, keys: list[str], since: str | None = None, until: str | None = None, event: str | None = None, module: str | None = None, version: str | None = None) -> DataFrame:
    """A row for each log (``keys``): its window, what can't be read, how much a question matches, and why it matches nothing.

    ``lines`` are decoded ones with the times around each fault (ts, event, payload, fault, after, before). Columns:
    first_event, last_event, events, lines_read, unreadable, unreadable_in_window (faults whose times overlap the
    window; an unknown end is open), matched, zero_reasons: of ``outside_coverage``, ``empty_window``, ``other_version``,
    ``unknown_module``, ``unknown_event`` those that empty it alone, else ``together``; none for a log without events.
    """
    if since and until and since > until:
        raise ValueError(f"until {until} lies before since {since}")
    ok, fault = ~F.col("fault"), F.col("fault")
    at = lambda x: F.lit(x).cast("timestamp")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    outside = F.lit(False)
    if until:
        outside = outside | F.coalesce(F.col("after") > at(until), F.lit(False))
    if since:
        outside = outside | F.coalesce(F.col("before") < at(since), F.lit(False))
    g = lines.groupBy(*keys).agg(
        F.min(F.when(ok, F.col("ts"))).alias("first_event"), F.max(F.when(ok, F.col("ts"))).alias("last_event"),
        count(ok).alias("events"), F.count("*").alias("lines_read"), count(fault).alias("unreadable"), count(fault & ~outside).alias("unreadable_in_window"),
        count(ok & matches(since, until, event, module, version)).alias("matched"), count(ok & matches(since, until)).alias("_window"), count(ok & matches(module=module, version=version)).alias("_module"),
        count(ok & matches(module=module)).alias("_path"), count(ok & matches(event=event)).alias("_event"),
    )
    apart = F.lit(False)
    if until:
        apart = apart | (at(until) < F.col("first_event"))
    if since:
        apart = apart | (at(since) > F.col("last_event"))
    alone = F.array_compact(F.array(
        F.when((F.col("_window") == 0) & F.lit(bool(since or until)), F.when(apart, "outside_coverage").otherwise("empty_window")),
        F.when((F.col("_module") == 0) & F.lit(bool(module)), F.when((F.col("_path") > 0) & F.lit(bool(version)), "other_version").otherwise("unknown_module")),
        F.when((F.col("_event") == 0) & F.lit(bool(event)), "unknown_event"),
    ))
    why = F.when(F.size(alone) == 0, F.array(F.lit("together"))).otherwise(alone)
    reasons = F.when((F.col("matched") == 0) & (F.col("events") > 0), why).otherwise(F.array().cast("array<string>"))
    return g.select(*keys, "first_event", "last_event", "events", "lines_read", "unreadable", "unreadable_in_window", "matched", reasons.alias("zero_reasons"))
