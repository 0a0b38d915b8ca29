"""Minimum version selection of a module graph, wave by wave, with replacements, exclusions, a depth bound and what makes it partial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depquarry.functions import semver
from depquarry.operators.graph import _checkpoints

BEST = "own string, asked string, path string, version string, depth int, expand boolean, expanded boolean, source string, local_path string"
EDGES = "from_path string, from_version string, to_path string, to_version string, wanted string, own string, pinned boolean"


def newer(a: Column, b: Column) -> Column:
    """Whether version ``a`` is above ``b``; of two without an order, the greater text."""
    ka, kb = semver.key(a), semver.key(b)
    return F.when(ka.isNotNull() & kb.isNotNull(), (ka > kb) | ((ka == kb) & (a > b))).when(ka.isNotNull() != kb.isNotNull(), ka.isNotNull()).otherwise(a > b)


def effective(requires: DataFrame, replaces: DataFrame | None, excludes: DataFrame | None) -> DataFrame:
    """``requires`` with what each requirement comes to: to_path, to_version, source (mvs, replace, local_replace), local_path.

    A replacement of the exact version goes before one of any (an empty old_version). A local one (``local``) leaves
    the coordinate as it is. A requirement whose effective coordinate is excluded is dropped, but no local one.
    """
    req = requires.select("path", "version", "req_path", "req_version", "go_version").distinct()
    to = {"to_path": F.col("req_path"), "to_version": F.col("req_version"), "source": F.lit("mvs"), "local_path": F.lit(None).cast("string")}
    if replaces is not None:
        local = F.coalesce("local", F.lit(False)) if "local" in replaces.columns else F.lit(False)
        r = replaces.select("old_path", F.coalesce("old_version", F.lit("")).alias("old_version"), F.struct("new_path", "new_version", local.alias("local")).alias("r")).dropDuplicates(["old_path", "old_version"])
        exact = r.where("old_version <> ''").select(F.col("old_path").alias("req_path"), F.col("old_version").alias("req_version"), F.col("r").alias("_e"))
        wild = r.where("old_version = ''").select(F.col("old_path").alias("req_path"), F.col("r").alias("_w"))
        req = req.join(exact, ["req_path", "req_version"], "left").join(wild, "req_path", "left").withColumn("_r", F.coalesce("_e", "_w"))
        moved = F.col("_r").isNotNull() & ~F.col("_r.local")
        to = {
            "to_path": F.when(moved, F.col("_r.new_path")).otherwise(F.col("req_path")), "to_version": F.when(moved, F.col("_r.new_version")).otherwise(F.col("req_version")),
            "source": F.when(F.col("_r").isNull(), "mvs").when(F.col("_r.local"), "local_replace").otherwise("replace"), "local_path": F.when(F.col("_r.local"), F.col("_r.new_path")),
        }
    req = req.select("path", "version", "req_path", "req_version", "go_version", *[c.alias(k) for k, c in to.items()])
    if excludes is not None:
        out = excludes.select(F.col("path").alias("to_path"), F.col("version").alias("to_version")).distinct().withColumn("_out", F.lit(True))
        req = req.join(out, ["to_path", "to_version"], "left").where("_out is null or source = 'local_replace'").drop("_out")
    return req.withColumn("old", semver.before_pruning(F.col("go_version")))


def _asks(hop: DataFrame) -> DataFrame:
    """What a wave's requirements ask for: a row per path, the newest version asked, a local replacement only where nothing else is."""
    w = Window.partitionBy("own")
    order = [F.col("bounded").asc(), (F.col("source") == "local_replace").asc(), semver.key(F.col("asked")).desc_nulls_last(), F.col("asked").desc(), F.col("path"), F.col("version")]
    x = hop.withColumn("_n", F.row_number().over(w.orderBy(*order)))
    x = x.withColumn("expand", F.max(F.col("expand") & ~F.col("bounded")).over(w)).withColumn("depth", F.min("depth").over(w))
    return x.where("_n = 1").drop("_n")


def resolve_graph(requires: DataFrame, target: tuple[str, str], replaces: DataFrame | None = None, excludes: DataFrame | None = None, failures: DataFrame | None = None, max_depth: int = 0, fetched_target: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, state) of the graph of a target module.

    ``requires`` (path, version, req_path, req_version, go_version): the manifests. ``replaces`` (old_path,
    old_version — empty for any, new_path, new_version, local) and ``excludes`` (path, version) are the target's;
    a fetched target's local replacements don't count, as no one has its folders. ``failures`` (path, version,
    reason): coordinates whose manifest could not be read.

    Each path that is required is one node. The versions required of it compete, also where a replacement
    stands for them; in a wave the newest asked for so far is expanded, once. A module from before pruning has
    its requirements' requirements expanded; of others only paths that the target itself requires are. A local
    replacement is a leaf: the first asked stays unless an unreplaced version above it is. Modules at ``max_depth``
    have what they require recorded, where nothing else of that path is, but not followed.

    nodes: (own, path, version, depth, source, local_path), source being target, mvs, replace, local_replace or a
    failure's reason; edges: (from_path, from_version, to_path, to_version, wanted), whose targets are moved to the
    version selected unless a replacement pins them; state: one row (partial, reasons, has_local_replace), where
    reasons are those of failures and ``depth_bounded: max_depth=N``. A lost executor costs a wave.
    """
    spark = requires.sparkSession
    _checkpoints(spark)
    if replaces is not None and "local" in replaces.columns and fetched_target:
        replaces = replaces.where(~F.coalesce("local", F.lit(False)))
    req = effective(requires, replaces, excludes).checkpoint()
    has_local = F.lit(False)
    if replaces is not None and "local" in replaces.columns:
        has_local = F.lit(not replaces.where(F.coalesce("local", F.lit(False))).isEmpty())
    failed = spark.createDataFrame([], "path string, version string, reason string") if failures is None else failures.select("path", "version", "reason").dropDuplicates(["path", "version"])

    path, version = target
    best = spark.createDataFrame([(path, version, path, version, 0, True, False, "target", None)], BEST).checkpoint()
    direct = req.where((F.col("path") == path) & (F.col("version") == version)).select(F.col("req_path").alias("own")).distinct().withColumn("_direct", F.lit(True)).checkpoint()
    edges = spark.createDataFrame([], EDGES)
    cut = False
    open_ = F.col("expand") & ~F.col("expanded") & (F.col("source") != "local_replace")
    while True:
        wave = best.where(open_).join(failed, ["path", "version"], "left").checkpoint()
        if wave.isEmpty():
            break
        broken = wave.where("reason is not null").select("own", "reason")
        bounded = (F.col("depth") >= max_depth) if max_depth else F.lit(False)
        hop = wave.where("reason is null").select("path", "version", "depth").distinct().join(req, ["path", "version"]).withColumn("bounded", bounded & (F.col("source") != "local_replace")).checkpoint()
        cut = cut or bool(max_depth) and not hop.where("bounded").isEmpty()
        edges = edges.unionByName(hop.select(F.col("path").alias("from_path"), F.col("version").alias("from_version"), "to_path", "to_version", F.col("req_version").alias("wanted"), F.col("req_path").alias("own"), (F.col("source") == "replace").alias("pinned"))).checkpoint()
        new = hop.join(direct, F.col("req_path") == F.col("own"), "left").select(
            F.col("req_path").alias("own"), F.col("req_version").alias("asked"), F.col("to_path").alias("path"), F.col("to_version").alias("version"), (F.col("depth") + 1).alias("depth"),
            (F.coalesce("_direct", F.lit(False)) | F.col("old")).alias("expand"), "source", "local_path", "bounded",
        )
        old = best.withColumn("expanded", F.col("expanded") | open_).join(broken, "own", "left").withColumn("source", F.coalesce("reason", "source")).drop("reason")
        both = old.alias("o").join(_asks(new).alias("a"), "own", "full")
        none, asked = F.col("o.asked").isNull(), F.col("a.asked").isNotNull()
        wins = none | (asked & ~F.col("a.bounded") & (F.col("a.source") != "local_replace") & newer(F.col("a.asked"), F.col("o.asked")))
        of = lambda c: F.when(wins, F.col(f"a.{c}")).otherwise(F.col(f"o.{c}")).alias(c)  # noqa: E731, B023
        best = both.select(
            "own", of("asked"), of("path"), of("version"), F.least("o.depth", "a.depth").alias("depth"), (F.coalesce("o.expand", F.lit(False)) | F.coalesce("a.expand", F.lit(False))).alias("expand"),
            F.when(wins, F.lit(False)).otherwise(F.col("o.expanded")).alias("expanded"), of("source"), of("local_path"),
        ).checkpoint()
    chosen = best.select("own", F.col("asked").alias("_v"))
    moved = edges.join(chosen, "own", "left").withColumn("to_version", F.when(F.col("pinned"), F.col("to_version")).otherwise(F.coalesce("_v", "to_version")))
    reasons = best.join(failed.select(F.col("reason").alias("source")).distinct(), "source", "left_semi").agg(F.array_sort(F.collect_set("source")).alias("r"))
    bound = F.array(F.lit(f"depth_bounded: max_depth={max_depth}")) if cut else F.array().cast("array<string>")
    state = reasons.select(F.concat(bound, "r").alias("reasons")).select((F.size("reasons") > 0).alias("partial"), "reasons", has_local.alias("has_local_replace"))
    nodes = best.select("own", "path", "version", "depth", "source", "local_path")
    return nodes, moved.select("from_path", "from_version", "to_path", "to_version", "wanted").distinct(), state


def select_versions(requires: DataFrame, target: tuple[str, str], replaces: DataFrame | None = None, excludes: DataFrame | None = None, max_depth: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of :func:`resolve_graph`, nodes as (path, version, depth, pinned)."""
    nodes, edges, _ = resolve_graph(requires, target, replaces, excludes, max_depth=max_depth)
    return nodes.select("path", "version", "depth", (F.col("source") == "replace").alias("pinned")), edges
