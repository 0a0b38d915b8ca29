"""Whose work a module is: what its licence texts' copyright lines say beside the modules that it is related to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depquarry.functions import semver, text

#: What an unfilled licence template has where a holder belongs.
PLACEHOLDER = r"<[^<>]*>|\[[^\[\]]*\]|\{[^{}]*\}"


def holders(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, holder, evidence): the holders that copyright ``lines`` (keys, line, holder, verbatim) name, with their distinct lines, sorted.

    Holders that differ in case alone are one, spelled as on its first line (by ``line``, then by the spelling); one of
    nothing but an unfilled placeholder is none. Null and blank holders and lines are left out.
    """
    h = F.trim("holder")
    named = lines.where((h != "") & (F.trim(F.regexp_replace(h, PLACEHOLDER, "")) != ""))
    said = F.when(F.trim("verbatim") != "", F.trim("verbatim"))
    one = named.groupBy(*keys, F.lower(h).alias("_h")).agg(F.min_by(h, F.struct("line", h)).alias("holder"), F.array_sort(F.collect_set(said)).alias("evidence"))
    return one.drop("_h")


def indicators(lines: DataFrame, related: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, signal, canonical, holders, evidence): signs of a republication, each module version on its own lines.

    ``keys`` name a version of ``path``, which is one of them. multiple_holders: more than one holder;
    holder_matches_path: a holder (the first of those sorted) names the owner of a ``related`` (path, other, by_replace)
    module of another family. One related by a replacement counts whatever its name, another one must share the base
    name; a relation of both kinds is one by replacement.
    """
    h = holders(lines, keys)
    many = h.groupBy(*keys).agg(F.array_sort(F.collect_set("holder")).alias("holders"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence")).where(F.size("holders") > 1)
    many = many.select(*keys, F.lit("multiple_holders").alias("signal"), F.lit(None).cast("string").alias("canonical"), "holders", "evidence")
    stem = lambda c: text.family(F.col(c))["stem"]
    r = related.where((F.col("other") != "") & (stem("other") != stem("path"))).groupBy("path", "other").agg(F.max("by_replace").alias("by_replace"))
    r = r.where(F.coalesce("by_replace", F.lit(False)) | text.base_names_overlap(F.col("path"), F.col("other")))
    met = h.join(r, "path").where(text.holder_names_owner(F.col("holder"), F.col("other")))
    met = met.groupBy(*keys, F.col("other").alias("canonical")).agg(F.min(F.struct("holder", "evidence")).alias("_f"))
    met = met.select(*keys, F.lit("holder_matches_path").alias("signal"), "canonical", F.array("_f.holder").alias("holders"), "_f.evidence")
    return many.unionByName(met)


def report(records: DataFrame, lines: DataFrame, related: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """A row for each module: (path, version, rule, candidates, status, many_holders, matched, versions_disagree).

    ``records`` (path, version) are the licence records held, ``lines`` (path, version, line, holder, verbatim) their
    copyright lines, ``pinned`` (path, version) what is asked for, if not each module's newest version. A record
    without a line is not_analysed, never none; so is a pin that no record has. ``matched`` counts the related modules
    whose owner a holder names; ``versions_disagree``: among several versions and without a pin, their statuses differ.
    """
    keys = ["path", "version"]
    sign = indicators(lines, related, keys).groupBy(*keys).agg(F.bool_or(F.col("signal") == "multiple_holders").alias("_many"), F.count_if(F.col("signal") == "holder_matches_path").alias("_matched"))
    stated = lines.where("holder is not null or verbatim is not null").select(*keys, F.lit(True).alias("_lines")).distinct()
    x = records.select(*keys).distinct().join(stated, keys, "left").join(sign, keys, "left")
    status = F.when(F.col("_lines").isNull(), "not_analysed").when(F.col("_many") | (F.col("_matched") > 0), "republication").otherwise("none")
    x = x.withColumn("status", status)
    each = Window.partitionBy("path")
    x = x.withColumn("candidates", F.count("*").over(each)).withColumn("_kinds", F.size(F.collect_set("status").over(each)))
    newest = each.orderBy(semver.key(F.col("version")).desc_nulls_last(), F.col("version").desc())
    if pinned is None:
        x = x.withColumn("_n", F.row_number().over(newest)).where("_n = 1").withColumn("rule", F.lit("newest"))
    else:
        x = pinned.select(*keys).distinct().join(x, keys, "left").withColumn("rule", F.lit("pinned")).withColumn("candidates", F.lit(None).cast("long"))
    apart = F.lit(False) if pinned is not None else F.col("_kinds") > 1
    none = lambda c, v: F.coalesce(c, F.lit(v))
    return x.select(*keys, "rule", "candidates", none("status", "not_analysed").alias("status"), none("_many", False).alias("many_holders"), none("_matched", 0).cast("long").alias("matched"), apart.alias("versions_disagree"))
