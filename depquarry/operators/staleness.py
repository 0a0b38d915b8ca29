"""How old a pin is: recorded answers that still hold are served, the rest is looked up, and what was learned is stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depquarry.functions import semver
from depquarry.functions.text import is_fresh

#: Fixed value: a path's major suffix, and that of hosts which write it after a dot.
FAMILY = r"^(.*?)(?:/v([2-9]|[1-9][0-9]+)|\.v([0-9]+))?$"


def family(path: Column) -> Column:
    """struct(stem, major) of a module path; a bare path has the major 0. A dot suffix counts on gopkg.in alone."""
    dotted = path.startswith("gopkg.in/")
    slash = F.regexp_extract(path, r"^(.*)/v([2-9]|[1-9][0-9]+)$", 2)
    dot = F.when(dotted, F.regexp_extract(path, r"^(.*)\.v([0-9]+)$", 2)).otherwise("")
    stem = F.when(dot != "", F.regexp_extract(path, r"^(.*)\.v([0-9]+)$", 1)).when(slash != "", F.regexp_extract(path, r"^(.*)/v([2-9]|[1-9][0-9]+)$", 1)).otherwise(path)
    major = F.when(dot != "", dot).when(slash != "", slash).otherwise("0")
    return F.struct(stem.alias("stem"), major.cast("long").alias("major"))


def probe_plan(path: Column, pinned: Column) -> Column:
    """struct(start, same_major): the first major that the upward walk asks for, and the own major that is asked besides.

    The walk starts above the larger of the path's major and the pin's. Only a ``+incompatible`` pin of 2 or more on a
    bare path asks for its own major too, as it may have been published again under its suffixed path.
    """
    v = semver.v_prefixed(F.coalesce(pinned, F.lit("")))
    own = F.coalesce(F.regexp_extract(F.coalesce(semver.major(v), F.lit("v0")), "v([0-9]+)", 1).cast("long"), F.lit(0))
    of_path = family(path)["major"]
    same = F.when((of_path == 0) & (own >= 2) & (semver.build(v) == "+incompatible"), own)
    return F.struct((F.greatest(of_path, own, F.lit(1)) + 1).alias("start"), same.alias("same_major"))


def resolve(asked: DataFrame, ledger: DataFrame, latest: DataFrame, published: DataFrame, now: Column, ttl_seconds: int, fresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(answers, writes) for the modules ``asked`` (path, pinned; a null pin asks by the newest version).

    ``ledger`` (path, latest, latest_at, looked_up_at, probed, from_major, newer_major, newer_version, asked_again,
    again_version): what earlier runs recorded, one row a path. ``latest`` (path, version, at): what a lookup finds;
    a path without a row there is a failed lookup. ``published`` (stem, major, version): what is there under a
    suffixed path, the newest version of each; a null version is a probe that failed, a missing row is an absent major.

    A row younger than the ttl is served whole if its walk started at the same major and the question of the own
    major, where the pin asks it, was put. Those paths are not probed. Else a row younger than the ttl gives the
    newest version and its own time, and only the probe is live; the others are looked up. ``fresh`` serves no row.

    answers (path, pinned, source, latest, latest_at, looked_up_at, probed, from_major, newer_major, newer_version,
    asked_again, again_version, error): source is ledger, mixed or live; a failed lookup answers with an error
    alone, a failed probe with probed false. writes: the rows to record; of paths with an error none, and none for
    a failed probe on top of a recorded answer. A path that is asked with several pins is answered for each; the
    last in the order of pins is written.
    """
    a = asked.select("path", "pinned").distinct()
    l = ledger.select("path", F.struct(*[c for c in ledger.columns if c != "path"]).alias("l"))
    x = a.join(l, "path", "left").withColumn("_fresh", F.lit(not fresh) & F.coalesce(is_fresh(F.col("l.looked_up_at"), now, ttl_seconds), F.lit(False)))
    found = latest.select("path", F.struct("version", "at").alias("f"))
    # the lookup leg: only paths whose row does not answer
    x = x.where("_fresh").withColumn("f", F.lit(None).cast(found.schema["f"].dataType)).unionByName(x.where("not _fresh").join(found, "path", "left"))
    x = x.withColumn("latest", F.when(F.col("_fresh"), F.col("l.latest")).otherwise(F.col("f.version"))).withColumn("latest_at", F.when(F.col("_fresh"), F.col("l.latest_at")).otherwise(F.col("f.at")))
    x = x.withColumn("error", F.when(~F.col("_fresh") & F.col("f").isNull(), "lookup failed"))
    pin = F.when(F.coalesce(F.col("pinned"), F.lit("")) != "", F.col("pinned")).otherwise(F.col("latest"))
    x = x.withColumn("_plan", probe_plan(F.col("path"), pin))
    whole = F.col("_fresh") & F.coalesce(F.col("l.probed"), F.lit(False)) & F.coalesce(F.col("l.from_major") == F.col("_plan.start"), F.lit(False))
    x = x.withColumn("_whole", whole & (F.col("_plan.same_major").isNull() | F.coalesce(F.col("l.asked_again"), F.lit(False))))
    x = x.withColumn("looked_up_at", F.when(F.col("_fresh"), F.col("l.looked_up_at")).otherwise(now))

    # the probe leg: what is served whole is not asked again
    live = x.where("not _whole and error is null").withColumn("_stem", family(F.col("path"))["stem"])
    p = published.select(F.col("stem").alias("_stem"), "major", F.col("version").alias("_v"))
    keys = ["path", "pinned"]
    walk = live.select(*keys, "_stem", F.col("_plan.start").alias("_start")).join(p, "_stem").where(F.col("major") >= F.col("_start"))
    # a null pin is a key like others
    w = Window.partitionBy("path", F.coalesce("pinned", F.lit(""))).orderBy("major")
    run = walk.withColumn("_n", F.row_number().over(w)).where(F.col("major") == F.col("_start") + F.col("_n") - 1)
    ends = run.groupBy(*keys).agg(F.min(F.when(F.col("_v").isNull(), F.col("major"))).alias("_failed"), F.max_by(F.struct("major", "_v"), F.when(F.col("_v").isNotNull(), F.col("major"))).alias("_top"))
    again = live.where("_plan.same_major is not null").select(*keys, "_stem", F.col("_plan.same_major").alias("major")).join(p, ["_stem", "major"], "left")
    again = again.select(*keys, F.struct(F.col("_v").alias("v")).alias("_again"))
    # a walk that meets a failure, or an own major whose probe failed, leaves the probe unrecorded
    same = lambda t: F.col("x.path").eqNullSafe(F.col(f"{t}.path")) & F.col("x.pinned").eqNullSafe(F.col(f"{t}.pinned"))
    broken = published.where("version is null").select(F.col("stem").alias("_stem"), F.col("major").alias("_m")).distinct().withColumn("_bad", F.lit(True))
    lv = live.alias("x").join(ends.alias("e"), same("e"), "left").join(again.alias("g"), same("g"), "left").select("x.*", "e._failed", "e._top", "g._again")
    lv = lv.join(broken, (lv["_stem"] == broken["_stem"]) & (F.col("_plan.same_major") == F.col("_m")), "left").drop(broken["_stem"])
    ok = F.col("_failed").isNull() & F.col("_bad").isNull()
    said = {
        "source": F.when(F.col("_fresh"), "mixed").otherwise("live"), "probed": ok, "from_major": F.col("_plan.start"), "newer_major": F.when(ok, F.col("_top.major")), "newer_version": F.when(ok, F.col("_top._v")),
        "asked_again": ok & F.col("_plan.same_major").isNotNull(), "again_version": F.when(ok, F.col("_again.v")),
    }
    columns = ["path", "pinned", "source", "latest", "latest_at", "looked_up_at", "probed", "from_major", "newer_major", "newer_version", "asked_again", "again_version", "error"]
    by_probe = lv.withColumns(said).select(*columns)
    served = x.where("_whole").select("path", "pinned", F.lit("ledger").alias("source"), "latest", "latest_at", "looked_up_at", *[F.col(f"l.{c}").alias(c) for c in ("probed", "from_major", "newer_major", "newer_version", "asked_again", "again_version")], "error")
    failed = x.where("error is not null").select("path", "pinned", F.lit("live").alias("source"), *[F.lit(None).cast(by_probe.schema[c].dataType).alias(c) for c in columns[3:12]], "error")
    answers = served.unionByName(by_probe).unionByName(failed)
    learned = by_probe.where("probed or source = 'live'")
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.col("pinned").desc_nulls_last()))
    writes = learned.withColumn("_n", last).where("_n = 1").drop("_n", "pinned", "source", "error")
    return answers, writes
