"""Frames of analysis: which records answer a question that is asked in one, and what a frame lets a later scan do.

A record's ``rooting`` states where its analysis started: ``isolated`` (the module alone), ``target:`` and a
coordinate ``path@version``, or nothing, as old records do. Answers of one frame are none to another's question,
so the frame is picked first and the ranking decides within it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISOLATED, TARGET = "isolated", "target:"


def stated(rooting: Column) -> Column:
    return F.coalesce(rooting != "", F.lit(False))


def target_of(rooting: Column) -> Column:
    """The coordinate that a rooting names; null for the others."""
    return F.when(rooting.startswith(TARGET), F.substring(rooting, F.lit(len(TARGET) + 1), F.char_length(rooting)))


def path_of(coordinate: Column) -> Column:
    """A coordinate's path: what stands before its last ``@``."""
    return F.regexp_extract(coordinate, r"^(.*)@[^@]*$", 1)


def tiered(records: DataFrame, keys: list[str], tiers: Sequence[Column], ranking: Sequence[Column], others: Column | None = None) -> DataFrame:
    """The record served of each key: of the first tier that has any, the first by ``ranking``.

    A row belongs to the first of ``tiers`` (boolean columns, null is false) that holds for it. Rows of no tier
    compete, behind all tiers, only where ``others`` holds: an expression over windows of the same keys may be
    used, as that nothing in the group states a frame. A key without a competing row has none. One shuffle by
    the keys serves all windows.
    """
    tier = F.coalesce(*[F.when(F.coalesce(t, F.lit(False)), F.lit(i)) for i, t in enumerate(tiers)], F.lit(len(tiers)))
    x = records.withColumn("_tier", tier).withColumn("_free", others if others is not None else F.lit(False))
    x = x.where((F.col("_tier") < len(tiers)) | F.col("_free"))
    w = Window.partitionBy(*keys).orderBy("_tier", *ranking)
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_tier", "_free")


def none_states(rooting: str, keys: list[str]) -> Column:
    """Whether no record of the key states its frame."""
    return ~F.max(stated(F.col(rooting))).over(Window.partitionBy(*keys))


def at_rooting(records: DataFrame, keys: list[str], rooting: str, wanted: Column, ranking: Sequence[Column]) -> DataFrame:
    """The record of each key within one frame; where no record of a key states a frame, all compete."""
    return tiered(records, keys, [F.col(rooting) == wanted], ranking, none_states(rooting, keys))


def for_consumer(records: DataFrame, keys: list[str], rooting: str, own: Column, ranking: Sequence[Column]) -> DataFrame:
    """The record that answers for builds which consume the module, and ``aside``: the isolated one that was declined.

    Records rooted at another coordinate than ``own`` go before all; without any, all records compete as they
    are, and nothing was declined. A record rooted at the module itself is neither answer nor aside.
    """
    r = F.col(rooting)
    consumer = F.coalesce(target_of(r) != own, F.lit(False))
    isolated = F.coalesce(r == ISOLATED, F.lit(False))
    w = Window.partitionBy(*keys)
    x = records.withColumn("_any", F.max(consumer).over(w)).withColumn("_iso", isolated)
    first = F.row_number().over(Window.partitionBy(*keys, "_iso").orderBy(*ranking))
    row = F.struct(*[F.col(c) for c in records.columns])
    x = x.withColumn("_i", first).withColumn("aside", F.max_by(F.when(F.col("_any"), row), F.when(isolated & (F.col("_i") == 1), 1)).over(w))
    return tiered(x, keys, [consumer], ranking, ~F.col("_any")).drop("_any", "_iso", "_i")


def for_tree(records: DataFrame, keys: list[str], rooting: str, path: Column, ranking: Sequence[Column]) -> DataFrame:
    """The record that may seed a probe of the working tree of ``path``: rooted at that path, else isolated.

    Another consumer's record is never served; where no record of a key states a frame, all compete.
    """
    r = F.col(rooting)
    return tiered(records, keys, [path_of(target_of(r)) == path, r == ISOLATED], ranking, none_states(rooting, keys))


def with_rooting(findings: Column, reachable: str, rooting: Column, kind: str = "rooting") -> Column:
    """``findings`` (an array of structs) whose answer ``reachable`` states the record's rooting where it states none.

    Answers that are null stay null, those that state a frame keep theirs.
    """
    stamp = lambda a: F.when(a.isNotNull(), a.withField(kind, F.when(F.coalesce(a[kind], F.lit("")) != "", a[kind]).otherwise(rooting)))
    return F.transform(findings, lambda f: f.withField(reachable, stamp(f[reachable])))


def route_start(rooting: Column, frame_path: Column, frame_version: Column, record_path: Column, record_version: Column) -> Column:
    """The coordinate in whose call graph a route starts, by its first frame; null if nothing names it.

    The rooting's target if the frame is in its path, as a main module's frames have no version; else the frame's
    own version; else the record's, if it is of that path.
    """
    target = target_of(rooting)
    at = lambda p, v: F.concat(p, F.lit("@"), v)
    named = F.coalesce(frame_path != "", F.lit(False))
    return F.when(
        named,
        F.coalesce(F.when(path_of(target) == frame_path, target), F.when(frame_version != "", at(frame_path, frame_version)), F.when((record_path == frame_path) & (record_version != ""), at(record_path, record_version))),
    )


def rescan(walks: DataFrame, modules: DataFrame, runs: DataFrame, records: DataFrame, readable: DataFrame, snapshot: str, ranking: Sequence[Column], force: bool = True) -> DataFrame:
    """(walk, module, action, root, reason): what a new scan of each walk's modules may do without changing its frame.

    ``walks`` (walk, local, project_dir), ``modules`` (walk, module), ``runs`` (walk, run, at), ``records`` (run,
    module, rooting, snapshot, status, and what ``ranking`` reads), ``readable`` (project_dir): the folders that can
    be read from here. The newest run of a walk, by time, then name, is the one to reproduce.

    A walk of a published module is scanned as such (root null). A local one with a folder is scanned there if it can
    be read, else refused. A local one without a folder is refused where any record of its newest run is rooted at
    a target, as there is no tree to root it at, and else scanned isolated. Refused walks do nothing at all. Unless
    ``force``, a module is reused where its served record of that frame is of ``snapshot`` and complete.
    """
    newest = runs.withColumn("_n", F.row_number().over(Window.partitionBy("walk").orderBy(F.col("at").desc(), F.col("run").desc()))).where("_n = 1").select("walk", "run")
    rooted = newest.join(records.where(F.col("rooting").startswith(TARGET)).select("run").distinct(), "run", "left_semi").select("walk").withColumn("_rooted", F.lit(True))
    there = readable.select("project_dir").distinct().withColumn("_there", F.lit(True))
    w = walks.join(rooted, "walk", "left").join(there, "project_dir", "left")
    folder = F.coalesce(F.col("project_dir") != "", F.lit(False))
    local = F.coalesce(F.col("local"), F.lit(False))
    reason = F.when(local & folder & F.col("_there").isNull(), "the project's folder can't be read from here").when(local & ~folder & F.col("_rooted").isNotNull(), "the run was rooted at a project whose folder is not known")
    w = w.select("walk", F.when(local & folder, F.col("project_dir")).alias("root"), reason.alias("reason"), local.alias("_local"))
    x = modules.select("walk", "module").distinct().join(w, "walk")
    action = F.when(F.col("reason").isNotNull(), "refuse").otherwise("rescan")
    if not force:
        wanted = F.when(F.col("root").isNotNull(), F.col("rooting").startswith(TARGET)).otherwise(F.col("rooting") == ISOLATED)
        known = newest.join(records, "run").join(w.select("walk", "root"), "walk").where(wanted)
        served = tiered(known, ["walk", "module"], [F.lit(True)], ranking)
        fit = served.where((F.col("snapshot") == snapshot) & (F.col("status") == "complete")).select("walk", "module").withColumn("_fit", F.lit(True))
        x = x.join(fit, ["walk", "module"], "left")
        action = F.when(F.col("reason").isNotNull(), "refuse").when(F.col("_fit"), "reuse").otherwise("rescan")
    said = F.coalesce("reason", F.when(action == "reuse", "the served record is complete and of this snapshot").when(F.col("root").isNotNull(), "in the project's frame").when(F.col("_local"), "isolated, as before").otherwise("a published module"))
    return x.select("walk", "module", action.alias("action"), F.when(F.col("reason").isNull(), F.col("root")).alias("root"), said.alias("reason"))
