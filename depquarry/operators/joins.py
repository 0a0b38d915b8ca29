"""Joins that the engine needs beyond equi-joins: version ranges, longest prefixes, overrides, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depquarry.functions import semver, text


def intervals(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi) from ordered events (position, kind, version): each introduced up to the fixed after it, else open.

    ``lo`` "0" and the empty version are below everything.
    """
    w = Window.partitionBy(*keys).orderBy("position")
    nxt = F.lead(F.struct("kind", "version")).over(w)
    x = events.withColumn("_next", nxt).where("kind = 'introduced'")
    return x.select(*keys, F.col("version").alias("lo"), F.when(F.col("_next.kind") == "fixed", F.col("_next.version")).alias("hi"))


def _bounds(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Sort keys of a range's bounds; null where it has none: "0", empty, null or unreadable."""
    return F.when(~lo.isin("", "0"), semver.key(semver.v_prefixed(lo))), semver.key(semver.v_prefixed(hi))


def _within(v: Column, lo: Column, hi: Column) -> Column:
    return v.isNull() | (F.coalesce(lo <= v, F.lit(True)) & F.coalesce(v < hi, F.lit(True)))


def in_interval(version: Column, lo: Column, hi: Column) -> Column:
    """lo <= version < hi by semver; no lower or upper bound where it is "0", empty or null; an unreadable version is inside."""
    return _within(semver.key(semver.v_prefixed(version)), *_bounds(lo, hi))


def with_ranges(modules: DataFrame, ranges: DataFrame) -> DataFrame:
    """Modules (path, version) with the ranges (lo, hi) of their path, and ``inside`` as ``in_interval`` has it.

    Sort keys are read off once for each row of either side, before the join; its pairs only compare them.
    """
    lo, hi = _bounds(F.col("lo"), F.col("hi"))
    m = modules.withColumn("_v", semver.key(semver.v_prefixed(F.col("version"))))
    x = m.join(ranges.withColumn("_lo", lo).withColumn("_hi", hi), "path")
    return x.withColumn("inside", _within(F.col("_v"), F.col("_lo"), F.col("_hi"))).drop("_v", "_lo", "_hi")


def affected(modules: DataFrame, ranges: DataFrame, advisories: DataFrame) -> DataFrame:
    """(path, version, id, fix): modules (path, version) that an advisory (id, path) covers, with the fix of the range that holds the version.

    ``ranges`` (id, path, lo, hi). An advisory that names a path without any range covers every version.
    """
    m = modules.select("path", "version").distinct()
    ranged = with_ranges(m, ranges).where("inside").groupBy("path", "version", "id").agg(F.min("hi").alias("fix"))
    bare = advisories.select("id", "path").distinct().join(ranges.select("id", "path").distinct(), ["id", "path"], "left_anti")
    return ranged.unionByName(m.join(bare, "path").select("path", "version", "id", F.lit(None).cast("string").alias("fix")))


def longest_prefix(items: DataFrame, item: str, prefixes: DataFrame, prefix: str, separators: str = "/") -> DataFrame:
    """``items`` with the longest ``prefix`` that equals the item or ends at one of its separators; null if there is none.

    Every item gives its own prefixes at separators, which meet the table by equality: no comparison of all with all.
    """
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(item), F.lit(1))), lambda i: (i == F.length(item)) | F.instr(F.lit(separators), F.substring(F.col(item), i + 1, F.lit(1))).cast("boolean"))
    own = items.select(item).distinct().withColumn("_p", F.explode(F.transform(cuts, lambda i: F.substring(F.col(item), F.lit(1), i))))
    best = own.join(prefixes.select(F.col(prefix).alias("_p")).distinct(), "_p").groupBy(item).agg(F.max_by("_p", F.length("_p")).alias(prefix))
    return items.join(best, item, "left")


def overridden(nodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """``nodes`` (path, version, spdx) with the override (path, version or empty, spdx) that holds: exact before path-wide; empty ones don't count."""
    o = overrides.where("spdx <> ''")
    exact = o.where("version <> ''").select("path", "version", F.col("spdx").alias("_exact")).dropDuplicates(["path", "version"])
    wide = o.where("version = ''").select("path", F.col("spdx").alias("_wide")).dropDuplicates(["path"])
    x = nodes.join(exact, ["path", "version"], "left").join(wide, "path", "left")
    return x.withColumn("spdx", F.coalesce("_exact", "_wide", "spdx")).withColumn("overridden", F.coalesce("_exact", "_wide").isNotNull()).drop("_exact", "_wide")


def fill_merge(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of both sides by key: the left's fields, those that are null or empty filled from the right; the right's own rows are added."""
    r = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in columns])
    x = left.select(*keys, *columns).join(r, keys, "full_outer")
    return x.select(*keys, *[F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"_r_{c}")).alias(c) for c in columns])


def disagreements(manifest: DataFrame, walk: DataFrame) -> DataFrame:
    """(compared, disagreeing): paths in both, and those of unequal versions; nothing compared means no answer, not agreement."""
    both = manifest.select("path", F.col("version").alias("m")).join(walk.select("path", F.col("version").alias("w")), "path")
    return both.agg(F.count("*").alias("compared"), F.count_if(F.col("m") != F.col("w")).alias("disagreeing"))


def last_containing(walks: DataFrame, members: DataFrame, newest: int = 50) -> DataFrame:
    """The newest of the ``newest`` newest walks (walk, taken) that has a member (walk); the bound comes before the join."""
    recent = walks.orderBy(F.col("taken").desc(), F.col("walk").desc()).limit(newest)
    return recent.join(members.select("walk").distinct(), "walk", "left_semi").orderBy(F.col("taken").desc(), F.col("walk").desc()).limit(1)


def judged(modules: DataFrame, ranges: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """(path, version, id, verdict): every advisory on a module's path judged: unjudgeable version, withdrawn, affected, not affected."""
    m = modules.select("path", "version").distinct()
    x = with_ranges(m, ranges).groupBy("path", "version", "id").agg(F.max("inside").alias("_in")).join(withdrawn.select("id", F.lit(True).alias("_w")).distinct(), "id", "left")
    verdict = F.when(~semver.is_valid(semver.v_prefixed(F.col("version"))), "unjudgeable").when(F.col("_w"), "withdrawn").when(F.col("_in"), "affected").otherwise("not affected")
    return x.select("path", "version", "id", verdict.alias("verdict"))


def with_measurement(nodes: DataFrame, records: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``nodes`` with the record's value and whether it was measured: no record is unmeasured, a record without a value unclassified."""
    r = records.select(*keys, F.col(value).alias("_v"), F.lit(True).alias("_r"))
    x = nodes.join(r, keys, "left")
    return x.withColumn(value, F.col("_v")).withColumn("measurement", F.when(F.col("_r").isNull(), "unmeasured").when(F.coalesce(F.col("_v"), F.lit("")) == "", "unclassified").otherwise("classified")).drop("_v", "_r")


def exploded_results(runs: DataFrame, run: str, results: str) -> DataFrame:
    """(run, path, version, hash) of a map from path@version to a record's hash; the key is split at its first @."""
    x = runs.select(run, F.explode(results).alias("_k", "hash"))
    at = F.instr("_k", "@")
    return x.select(run, F.when(at > 0, F.substring("_k", F.lit(1), at - 1)).otherwise(F.col("_k")).alias("path"), F.when(at > 0, F.substring("_k", at + 1, F.length("_k"))).otherwise("").alias("version"), "hash")


def pins(requires: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, version) for every path that provides an import; none at all if one import has no provider.

    ``requires`` (path, version), the newest version of a path counts; ``imports`` (name).
    """
    w = Window.partitionBy("path").orderBy(semver.key(F.col("version")).desc_nulls_last(), F.col("version").desc())
    newest = requires.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("path", "version")
    given = longest_prefix(imports.select("name").distinct(), "name", newest, "path")
    if not given.where("path is null").isEmpty():
        return newest.where(F.lit(False))
    return newest.join(given.select("path"), "path", "left_semi")


def republications(modules: DataFrame, holders: DataFrame, related: DataFrame) -> DataFrame:
    """(path, signal, canonical): signs that a module is another's copy under a new path.

    multiple_holders: its licence names more than one holder; holder_matches_path: a holder names the
    owner of a related path. A relation by replacement beats one by the ledger, which must share the
    base name. ``modules`` (path), ``holders`` (path, holder), ``related`` (path, other, by_replace).
    """
    h = holders.where("holder <> ''").select("path", "holder").distinct().join(modules.select("path").distinct(), "path", "left_semi")
    many = h.groupBy("path").agg(F.count("*").alias("_n")).where("_n > 1").select("path", F.lit("multiple_holders").alias("signal"), F.lit(None).cast("string").alias("canonical"))
    r = related.where(F.col("other") != F.col("path")).groupBy("path", "other").agg(F.max("by_replace").alias("by_replace"))
    r = r.where(F.col("by_replace") | text.base_names_overlap(F.col("path"), F.col("other")))
    match = h.join(r, "path").where(text.holder_names_owner(F.col("holder"), F.col("other"))).select("path", F.lit("holder_matches_path").alias("signal"), F.col("other").alias("canonical")).distinct()
    return many.unionByName(match)
