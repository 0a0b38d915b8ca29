"""Differences of two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], complete: Column | None = None) -> DataFrame:
    """(keys, change, a_*, b_*): added, removed or changed rows; with ``complete`` false, every change is unresolved.

    Keys must be unique on either side. Equal rows are left out; nulls are equal to nulls.
    """
    x = a.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in columns]), keys, "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~same, "changed")
    if complete is not None:
        change = F.when(change.isNotNull() & ~complete, "unresolved").otherwise(change)
    return x.withColumn("change", change).where("change is not null").drop("_a", "_b")


def scan_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, finding, change): new, resolved, withdrawn, unresolved or reachability-changed findings between two runs.

    Rows (path, finding, withdrawn, reachable — null if not measured, complete). A finding that is gone is
    resolved only if the newer run measured its module; a reachability changes from null too.
    """
    o = old.select("path", "finding", F.lit(True).alias("_o"), F.col("reachable").alias("r0"), F.col("complete").alias("c0"))
    n = new.select("path", "finding", F.lit(True).alias("_n"), "withdrawn", F.col("reachable").alias("r1"), F.col("complete").alias("c1"))
    measured = new.groupBy("path").agg(F.min("complete").alias("_m"))
    x = o.join(n, ["path", "finding"], "full_outer").join(measured, "path", "left")
    change = (
        F.when(F.col("_o").isNull(), "new")
        .when(F.col("_n").isNull() & ~F.coalesce("_m", F.lit(False)), "unresolved")
        .when(F.col("_n").isNull(), "resolved")
        .when(F.col("withdrawn"), "withdrawn")
        .when(F.col("c0") != F.col("c1"), "unresolved")
        .when(~F.col("r0").eqNullSafe(F.col("r1")), "reachability-changed")
    )
    return x.select("path", "finding", change.alias("change")).where("change is not null")


def sides(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): where each key occurs: a, b or both."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full_outer")
    return x.select(*keys, F.when(F.col("_b").isNull(), "a").when(F.col("_a").isNull(), "b").otherwise("both").alias("side"))


def list_diff(a: Column, b: Column) -> Column:
    """struct(added, removed, common), each sorted and distinct."""
    return F.struct(F.array_sort(F.array_except(b, a)).alias("added"), F.array_sort(F.array_except(a, b)).alias("removed"), F.array_sort(F.array_intersect(a, b)).alias("common"))


def reconcile(listed: DataFrame, present: DataFrame, required: DataFrame) -> DataFrame:
    """(path, kind): where a vendor list, a tree and the requirements disagree.

    ``listed`` (path, version), ``present`` (path, digest), ``required`` (path, version, digest). Kinds:
    missing (listed, not there), extra (there, not listed), version mismatch, unlisted requirement,
    edited (digests differ), unmeasured (no digest to compare).
    """
    x = listed.select("path", F.col("version").alias("lv")).join(present.select("path", F.col("digest").alias("pd"), F.lit(True).alias("_p")), "path", "full_outer")
    x = x.join(required.select("path", F.col("version").alias("rv"), F.col("digest").alias("rd")), "path", "full_outer")
    found = F.array_compact(F.array(
        F.when(F.col("lv").isNotNull() & F.col("_p").isNull(), "missing"),
        F.when(F.col("lv").isNull() & F.col("_p").isNotNull(), "extra"),
        F.when(F.col("lv") != F.col("rv"), "version mismatch"),
        F.when(F.col("rv").isNotNull() & F.col("lv").isNull(), "unlisted requirement"),
        F.when(F.col("pd") != F.col("rd"), "edited"),
        F.when(F.col("_p").isNotNull() & F.col("rv").isNotNull() & (F.col("pd").isNull() | F.col("rd").isNull()), "unmeasured"),
    ))
    return x.select("path", F.explode(found).alias("kind"))


def api_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(package, kind, name, change) of public symbols (package, kind, name, signature): added, removed, changed, spelling-only; testdata packages are left out.

    Signatures that differ in white space alone are spelling-only. Keys must be unique on either side.
    """
    real = ~F.array_contains(F.split("package", "/"), "testdata")
    x = snapshot_diff(old.where(real), new.where(real), ["package", "kind", "name"], ["signature"])
    bare = lambda c: F.regexp_replace(F.col(c), r"\s+", "")
    return x.select("package", "kind", "name", F.when((F.col("change") == "changed") & (bare("a_signature") == bare("b_signature")), "spelling-only").otherwise(F.col("change")).alias("change"))


def partition_coverage(wanted: DataFrame, measured: DataFrame, frame: str) -> DataFrame:
    """(path, state): covered in the frame, else why not: superseded, other frame, or none.

    ``measured`` (path, frame, superseded).
    """
    g = measured.groupBy("path").agg(F.max((F.col("frame") == frame) & ~F.col("superseded")).alias("_c"), F.max((F.col("frame") == frame) & F.col("superseded")).alias("_s"), F.max(F.col("frame") != frame).alias("_o"))
    x = wanted.select("path").distinct().join(g, "path", "left")
    return x.select("path", F.when(F.col("_c"), "covered").when(F.col("_o"), "other frame").when(F.col("_s"), "superseded").otherwise("none").alias("state"))


def directive_diff(old: DataFrame, new: DataFrame, identity: list[str], rating: str) -> DataFrame:
    """(identity, change, before, after): directives added, removed, or reclassified by another rating; repeated ones count once."""
    one = lambda d, name: d.groupBy(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]).alias("identity")).agg(F.min(rating).alias(name), F.lit(True).alias(f"in_{name}"))
    both = one(old, "before").join(one(new, "after"), "identity", "full_outer")
    change = F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "reclassified")
    return both.withColumn("change", change).where("change IS NOT NULL").select("identity", "change", "before", "after")


def merged(a: Column, b: Column) -> Column:
    """The distinct members of two lists, sorted; a null list adds none."""
    none = lambda x: F.coalesce(x, F.filter(F.coalesce(a, b), lambda v: F.lit(False)))
    return F.array_sort(F.array_union(none(a), none(b)))
