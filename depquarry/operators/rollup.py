"""Roll-ups that keep what was not measured apart from what was measured and empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with its ``place`` from 1 in the total order of ``keys``: ranges are numbered apart, and what stands before a range is added."""
    from depquarry.operators.graph import _checkpoints

    _checkpoints(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # cut here, so both reads see the same ranges; equal keys share one
    ranged = df.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()).checkpoint()
    before, n = [], 0
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():
        before += [F.lit(r["_range"]), F.lit(n).cast("long")]
        n += r["count"]
    offset = F.element_at(F.create_map(*before), F.col("_range")) if before else F.lit(0).cast("long")
    return ranged.withColumn("place", F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) + offset).drop("_range")


#: The keys of total orders; false comes before true, shorter lists of an implementation's methods before longer.
CALL_NODE_ORDER = ["id", "module", "package", "symbol", "receiver", "file", "line", "is_external", "is_exported", "uses_unsafe", "is_assembly", "uses_plugin", "is_test"]
CALL_EDGE_ORDER = ["from_id", "to_id", "file", "line", "kind", "confidence", "reflect"]
INTERFACE_ORDER = ["id", "package", "name", "file", "line", "is_test", "methods"]
IMPLEMENTATION_ORDER = ["interface_id", "type_id", "package", "file", "line", "is_test", "n_methods", "methods"]
SYMBOL_REF_ORDER = ["module_path", "module_version", "package_path", "symbol_kind", "parent_type"]


def implementations_placed(df: DataFrame) -> DataFrame:
    """Implementations with their ``place``; methods are lists of (method, node_id)."""
    return placed(df.withColumn("n_methods", F.size("methods")), IMPLEMENTATION_ORDER).drop("n_methods")


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, which has a row for each of its keys, null ones included."""
    r = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(r, same).drop(*[f"_k_{k}" for k in keys])


def placed_in(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """``df`` with its ``place`` from 1 in the order of ``position`` within its group of ``keys``.

    Groups are cut into ranges and numbered a range at a time, so a group of any size is no single
    task's sort; what a group has in the ranges before is added, from one row for each group and range.
    """
    from depquarry.operators.graph import _checkpoints

    _checkpoints(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # cut here, so both reads see the same ranges
    ranged = df.repartitionByRange(parts, *keys, position).withColumn("_range", F.spark_partition_id()).checkpoint()
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    n = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_earlier", F.coalesce(earlier, F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(position))
    return _beside(ranged.withColumn("_own", own), n, [*keys, "_range"]).withColumn("place", F.col("_own") + F.col("_earlier")).drop("_own", "_earlier", "_range")


def findings_axis(df: DataFrame, keys: list[str], finding: str, withdrawn: str) -> DataFrame:
    """(keys, n_findings, axis): Clean without a finding, Affected with one that stands, Withdrawn with others alone."""
    g = df.groupBy(*keys).agg(F.count(finding).alias("n_findings"), F.count_if(F.col(finding).isNotNull() & ~F.coalesce(F.col(withdrawn), F.lit(False))).alias("_stand"))
    axis = F.when(F.col("n_findings") == 0, "Clean").when(F.col("_stand") > 0, "Affected").otherwise("Withdrawn")
    return g.withColumn("axis", axis).drop("_stand")


def run_status(modules: DataFrame, keys: list[str], status: str) -> DataFrame:
    """(keys, total, failed, gaps, affected, status) of scan runs, worst first; a run without modules has failed."""
    is_ = lambda *x: F.count_if(F.col(status).isin(*x))
    g = modules.groupBy(*keys).agg(F.count(status).alias("total"), is_("Failed").alias("failed"), is_("Failed", "Unscannable").alias("gaps"), is_("Affected").alias("affected"))
    s = F.when(F.col("failed") == F.col("total"), "ScanFailed").when(F.col("gaps") > 0, "Partial").when(F.col("affected") > 0, "Affected").otherwise("AllClean")
    return g.withColumn("run_status", s)


def walk_status(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nodes, failures, walk_status) from nodes (status, is_target, cancelled)."""
    bad = ~F.col("status").isin("succeeded", "local_replace")
    g = nodes.groupBy(*keys).agg(
        F.count("*").alias("nodes"), F.count_if(F.col("status") != "succeeded").alias("failures"), F.coalesce(F.max("cancelled"), F.lit(False)).alias("_c"),
        F.coalesce(F.max(F.when(F.col("is_target"), ~bad)), F.lit(False)).alias("_t"), F.coalesce(F.max(bad), F.lit(False)).alias("_p"),
    )
    s = F.when(F.col("_c"), "Cancelled").when(~F.col("_t"), "Failed").when(F.col("_p"), "Partial").otherwise("Succeeded")
    return g.withColumn("walk_status", s).drop("_c", "_t", "_p")


def coverage(df: DataFrame, keys: list[str], measured: Column) -> DataFrame:
    """(keys, total, measured, unmeasured, percent): percent of measured rows, null for none at all."""
    g = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(measured).alias("measured"))
    return g.withColumn("unmeasured", F.col("total") - F.col("measured")).withColumn("percent", F.when(F.col("total") > 0, F.round(100.0 * F.col("measured") / F.col("total"), 2)))


def verification_coverage(df: DataFrame, keys: list[str], bucket: str, local: str) -> DataFrame:
    """(keys, recorded, local, cross_verified, checksum_db, unverified, cross_verifiable, collapsed)."""
    n = lambda c: F.count_if(c)
    b = F.col(bucket)
    g = df.groupBy(*keys).agg(
        n(b.isNotNull()).alias("recorded"), n(F.col(local)).alias("local"), n(~F.col(local) & (b == "cross-verified")).alias("cross_verified"),
        n(~F.col(local) & (b == "checksum db")).alias("checksum_db"), n(~F.col(local) & (b.isNull() | (b == "unverified"))).alias("unverified"),
    )
    g = g.withColumn("cross_verifiable", F.col("cross_verified") + F.col("checksum_db"))
    return g.withColumn("collapsed", (F.col("cross_verifiable") > 0) & (F.col("cross_verified") == 0))


def generations(df: DataFrame, keys: list[str], count: str) -> DataFrame:
    """(keys, generations, total): rows and the sum of a count, 0 where none was counted."""
    return df.groupBy(*keys).agg(F.count("*").alias("generations"), F.coalesce(F.sum(count), F.lit(0)).alias("total"))


def value_conflicts(df: DataFrame, keys: list[str], value: str, exemplar: str) -> DataFrame:
    """(keys, value, exemplar): the distinct values of keys that state more than one, each with its smallest exemplar."""
    v = df.where((F.col(value).isNotNull()) & (F.col(value).cast("string") != "")).groupBy(*keys, value).agg(F.min(exemplar).alias("exemplar"))
    return v.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n > 1").drop("_n")


def first_seen(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``df`` with first_seen, the earliest time of its key."""
    return df.withColumn("first_seen", F.min(at).over(Window.partitionBy(*keys)))


def best_per_group(df: DataFrame, keys: list[str], confidence: str, position: str) -> DataFrame:
    """The row of the highest confidence per group; of equals the first by position."""
    w = Window.partitionBy(*keys).orderBy(F.col(confidence).desc_nulls_last(), F.col(position))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sorted_set(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(name))


def merkle_roots(leaves: DataFrame, keys: list[str], position: str, data: Column) -> DataFrame:
    """(keys, n_leaves, root): the Merkle tree hash of each group's leaves in the order of ``position``.

    Leaf hashes are of 0x00 and the data, inner ones of 0x01 and both children; a tree splits at the
    largest power of two below its size. Level by level, neighbours at places 2k and 2k + 1 meet in one
    row, and a last one without a neighbour rises as it is: that gives the same tree. Positions are
    unique in a group.
    """
    h = F.sha2(F.concat(F.unhex(F.lit("00")), data.cast("binary")), 256)
    x = placed_in(leaves.select(*keys, F.col(position).alias("_at"), h.alias("_h")), keys, "_at").select(*keys, (F.col("place") - 1).alias("_i"), "_h")
    sizes = x.groupBy(*keys).agg(F.count("*").alias("n_leaves"))
    most = sizes.agg(F.max("n_leaves")).first()[0] or 0
    while most > 1:
        node = F.when(F.count("*") == 1, F.max("_h")).otherwise(F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(F.min_by("_h", "_i")), F.unhex(F.max_by("_h", "_i"))), 256))
        x = x.groupBy(*keys, F.floor(F.col("_i") / 2).alias("_k")).agg(node.alias("_h")).withColumnRenamed("_k", "_i")
        most = (most + 1) // 2
    return sizes.join(x.select(*keys, F.col("_h").alias("root")), keys)


def fault_bounds(lines: DataFrame, order: str, at: str, keys: list[str] | None = None, block: Column | None = None) -> DataFrame:
    """``lines`` with ``after`` and ``before``: the nearest times stated before and behind each line.

    ``block`` rises with the order and cuts it into parts: each is a window of its own, and what it
    lacks comes from the blocks around it, of which one row each is compared.
    """
    by = [*(keys or []), *(["_block"] if block is not None else [])]
    x = lines if block is None else lines.withColumn("_block", block)
    w = Window.partitionBy(*by).orderBy(order)
    x = x.withColumn("after", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.first(at, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    if block is None:
        return x
    stated = F.when(F.col(at).isNotNull(), F.col(order))
    ends = lines.withColumn("_block", block).groupBy(*by).agg(F.max_by(at, stated).alias("_last"), F.min_by(at, stated).alias("_first"))
    c = Window.partitionBy(*(keys or [])).orderBy("_block")
    ends = ends.select(*by, F.last("_last", True).over(c.rowsBetween(Window.unboundedPreceding, -1)).alias("_last"), F.first("_first", True).over(c.rowsBetween(1, Window.unboundedFollowing)).alias("_first"))
    return _beside(x, ends, by).withColumn("after", F.coalesce("after", "_last")).withColumn("before", F.coalesce("before", "_first")).drop("_block", "_last", "_first")


#: Rows up to the end of a page that one task takes; pages that end later are cut from ranges.
PAGE_ROWS = 10_000


def page(df: DataFrame, order: list[Column], limit: int = 0, offset: int = 0) -> DataFrame:
    """Rows in a total order, from ``offset``; a limit of 0 or less is none."""
    if offset <= 0:
        out = df.orderBy(*order)
        return out.limit(limit) if limit > 0 else out
    if 0 < limit <= PAGE_ROWS - offset:
        return df.orderBy(*order).offset(offset).limit(limit)
    from depquarry.operators.graph import _checkpoints

    _checkpoints(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # cut here, so both reads see the same ranges
    ranged = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    last, n, whole, cut = offset + limit, 0, [], []
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():
        low, n = n, n + r["count"]
        if low >= offset and (limit <= 0 or n <= last):
            whole.append(r["_range"])
        elif n > offset and (limit <= 0 or low < last):
            cut.append((r["_range"], offset - low, last - low))
    out = ranged.where(F.col("_range").isin(whole)).drop("_range")
    # at most two ranges hold an end of the page, and only they are numbered
    for k, a, b in cut:
        x = ranged.where(F.col("_range") == k).withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
        out = out.unionByName(x.where((F.col("_n") > a) & ((F.col("_n") <= b) if limit > 0 else F.lit(True))).drop("_range", "_n"))
    return out.orderBy(*order)


def truncated(df: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, bool]:
    """The first ``limit`` rows, and whether there are more: one row more is asked for, nothing is counted."""
    more = df.orderBy(*order).limit(limit + 1)
    return df.orderBy(*order).limit(limit), more.count() > limit


def first_rows(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with ``more``: whether others were cut off."""
    rows, more = truncated(df, order, limit)
    return rows.withColumn("more", F.lit(more))
