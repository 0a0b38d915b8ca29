"""Graph operators over edge tables: neighbours, closures, paths, version selection.

Loops run on the driver, one round per level or wave; each round is a join of the frontier with the
edges. What is settled is cut with checkpoint() in the shared folder, so a lost executor costs a
round. No node or edge is collected.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Edge confidences, the weakest first; what is not named ranks with Unknown.
CONFIDENCES = ("Unknown", "CHA-overapprox", "Framework", "VTA", "Direct")


def confidence_rank(c: Column) -> Column:
    return F.greatest(F.coalesce(F.array_position(F.array(*[F.lit(x) for x in CONFIDENCES]), c), F.lit(0)).cast("int") - 1, F.lit(0))


def confidence_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in CONFIDENCES]), (rank + 1).cast("int"))


def _checkpoints(spark: SparkSession) -> None:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="depquarry-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    _checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a frontier (a name or two and two numbers each) up to which it is broadcast; larger ones are shuffled.
FRONTIER_ROWS = 100_000


def _sized(frontier: DataFrame, rows: int) -> DataFrame:
    """A frontier as a side of a join: broadcast if its counted rows are few, so the edges stay where they are."""
    return F.broadcast(frontier) if rows <= FRONTIER_ROWS else frontier


def _kept(edges: DataFrame) -> DataFrame:
    """Edges that every round reads, as a Parquet table in the shared folder: in columns and packed, as a checkpoint is not."""
    path = shared_path(edges.sparkSession, "edges")
    edges.write.parquet(path)
    return edges.sparkSession.read.schema(edges.schema).parquet(path)


def _grown(settled: DataFrame, step: DataFrame, rounds: int) -> DataFrame:
    """``settled`` with a step that is checkpointed itself; the union is written anew every eighth round, so plans stay short."""
    out = settled.unionByName(step)
    return out.checkpoint() if rounds % 8 == 0 else out


def callees(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.where(F.col("src") == symbol).distinct()


def callers(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.where(F.col("dst") == symbol).distinct()


def levels(edges: DataFrame, roots: DataFrame, max_depth: int = 0) -> DataFrame:
    """(node, depth) of everything reachable from ``roots`` (node) along ``edges`` (src, dst), roots at depth 0.

    Level by level; ``max_depth`` 0 is unlimited. Cycles, self-edges and repeated edges don't matter.
    """
    e = _kept(edges.select("src", "dst"))
    settled = roots.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    frontier, depth = settled.select("node"), 0
    rows = frontier.count()
    while max_depth == 0 or depth < max_depth:
        depth += 1
        found = _sized(frontier, rows).join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(settled, "node", "left_anti")
        frontier = found.checkpoint()
        rows = frontier.count()
        if not rows:
            break
        settled = _grown(settled, frontier.withColumn("depth", F.lit(depth)), depth)
    return settled


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): the whole closure without the origins, even on a cycle."""
    return levels(edges, roots).where("depth > 0").select("node")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def traverse(edges: DataFrame, root: str, max_depth: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): what the root reaches, and every edge out of a node expanded, to visited ones too."""
    spark = edges.sparkSession
    seen = levels(edges, spark.createDataFrame([(root,)], "node string"), max_depth)
    expanded = seen if max_depth == 0 else seen.where(F.col("depth") < max_depth)
    hops = edges.join(expanded.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst").distinct()
    return seen.where("depth > 0"), hops


def dependents(edges: DataFrame, nodes: DataFrame, target: str, root: str | None = None) -> DataFrame:
    """(node, direct, is_root): who names the target, one hop back; the root's row only where it is asked for, first."""
    found = edges.where(F.col("dst") == target).select(F.col("src").alias("node")).distinct()
    out = found.join(nodes.select("node", "direct"), "node", "left").withColumn("is_root", F.lit(False) if root is None else F.col("node") == root)
    return out.orderBy(F.col("is_root").desc(), "node")


def shortest_path(edges: DataFrame, entries: DataFrame, targets: DataFrame) -> DataFrame:
    """(node, depth, path) of the targets nearest to any entry; of equal paths the smallest predecessor at each step.

    ``entries`` and ``targets`` have node. Paths grow by a node a level, and the search ends at the
    first level that holds a target.
    """
    _checkpoints(edges.sparkSession)
    e = edges.select("src", "dst").distinct().checkpoint()
    settled = entries.select("node").distinct().select("node", F.array("node").alias("path")).checkpoint()
    frontier, rounds = settled, 0
    while True:
        rounds += 1
        hit = frontier.join(targets.select("node").distinct(), "node", "left_semi")
        if not hit.isEmpty():
            return hit.select("node", (F.size("path") - 1).alias("depth"), "path")
        found = frontier.join(e, F.col("node") == F.col("src")).groupBy("dst").agg(F.min_by("path", "src").alias("path")).select(F.col("dst").alias("node"), "path")
        frontier = found.join(settled, "node", "left_anti").select("node", F.concat("path", F.array("node")).alias("path")).checkpoint()
        if frontier.isEmpty():
            return frontier.select("node", (F.size("path") - 1).alias("depth"), "path")
        settled = _grown(settled, frontier, rounds)


def predecessors(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(node, pred, depth): for every node of ``reached`` (node, depth) the smallest node one level nearer that names it; null at depth 0."""
    up = edges.select("src", "dst").distinct().join(reached.select(F.col("node").alias("src"), (F.col("depth") + 1).alias("depth")), "src")
    best = up.groupBy(F.col("dst").alias("node"), "depth").agg(F.min("src").alias("pred"))
    return reached.select("node", "depth").join(best, ["node", "depth"], "left").select("node", "pred", "depth")


def paths_back(preds: DataFrame, targets: DataFrame) -> DataFrame:
    """(node, path): the way from a root to each of ``targets`` (node) that ``preds`` (node, pred; null for a root) state, root first.

    ``preds`` has a row for each node. Jumps double every round, first without paths, to find what leads to a target;
    only those nodes' pieces of path are then put together, so rounds grow with the logarithm of the longest path. A
    target that ``preds`` doesn't name, or whose way ends at such a node, has no row. Circles are refused.
    """
    _checkpoints(preds.sparkSession)
    p = preds.select("node", "pred").checkpoint()
    most = p.count().bit_length()
    jumps = [p.where("pred IS NOT NULL").select("node", F.col("pred").alias("head")).checkpoint()]
    while not jumps[-1].isEmpty():
        if len(jumps) > most:
            raise ValueError("predecessors run in a circle")
        j = jumps[-1]
        jumps.append(j.join(j.select(F.col("node").alias("head"), F.col("head").alias("_next")), "head").select("node", F.col("_next").alias("head")).checkpoint())
    need = targets.select("node").distinct()
    used = need
    for j in reversed(jumps[:-1]):
        used = used.unionByName(used.join(j, "node").select(F.col("head").alias("node"))).distinct().checkpoint()
    # a piece ends at its node and starts behind ``head``, the next node up
    pieces = p.join(used, "node", "left_semi").select("node", F.col("pred").alias("head"), F.array("node").alias("path")).checkpoint()
    while not pieces.where("head IS NOT NULL").isEmpty():
        upper = pieces.select(F.col("node").alias("head"), F.col("head").alias("_next"), F.col("path").alias("_upper"))
        joined = pieces.where("head IS NOT NULL").join(upper, "head").select("node", F.col("_next").alias("head"), F.concat("_upper", "path").alias("path"))
        pieces = pieces.where("head IS NULL").unionByName(joined).checkpoint()
    return pieces.join(need, "node", "left_semi").select("node", "path")


def widest_paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, rank, depth, pred): the widest path to each node: the strongest weakest edge, then the fewest hops, then the smallest predecessor.

    ``edges`` (src, dst, rank 0 to 4); roots have rank 5, depth 0 and no predecessor. Nodes settle by
    falling rank, within a rank by ascending depth, all of one rank and depth in a round. A round joins
    the edges with the nodes that just settled only; the best offer to each node that is still open is
    kept. Edges without a rank or an end are left out; an edge to a node that nothing names is one like another.
    """
    # of repeated edges the strongest wins by itself, as the best offer to a node is kept
    e = _kept(edges.where("rank BETWEEN 0 AND 4 AND src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", F.col("rank").alias("edge")))
    settled = roots.select("node").distinct().select("node", F.lit(5).alias("rank"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("pred")).checkpoint()
    step, offers, rounds, rows = settled, None, 0, settled.count()
    while True:
        rounds += 1
        new = _sized(step, rows).join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.least("rank", "edge").alias("rank"), (F.col("depth") + 1).alias("depth"), F.col("src").alias("pred"))
        new = new.join(settled.select("node"), "node", "left_anti")
        best = F.min(F.struct((-F.col("rank")).alias("down"), "depth", "pred")).alias("x")
        every = new if offers is None else offers.where(later).unionByName(new)
        offers = every.groupBy("node").agg(best).select("node", (-F.col("x.down")).alias("rank"), "x.depth", "x.pred").checkpoint()
        # no path over open nodes can reach these by more, or by as much and sooner
        head = offers.agg(F.min(F.struct((-F.col("rank")).alias("down"), "depth")).alias("x")).first()["x"]
        if head is None:
            return settled
        now = (F.col("rank") == -head["down"]) & (F.col("depth") == head["depth"])
        step, later = offers.where(now), ~now
        rows = step.count()
        settled = _grown(settled, step, rounds)


def roots_of(nodes: DataFrame, application: bool = False) -> DataFrame:
    """Owned nodes (owned, exported, symbol) that are exported or ``init``; of an application, or where there is none, all owned."""
    owned = nodes.where("owned")
    if application:
        return owned
    marked = owned.where(F.col("exported") | (F.col("symbol") == "init"))
    return owned if marked.isEmpty() else marked


def subgraph(nodes: DataFrame, edges: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes whose coordinate or original coordinate is in ``scope`` (node); edges with both ends among their identities."""
    inside = scope.select(F.col("node").alias("_s")).distinct()
    kept = nodes.withColumn("_id", F.explode(F.array_distinct(F.array_compact(F.array("node", "original"))))).join(inside, F.col("_id") == F.col("_s"), "left_semi").drop("_id").distinct()
    ids = kept.select(F.explode(F.array_compact(F.array("node", "original"))).alias("id")).distinct()
    e = edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
    return kept, e


def superseded(edges: DataFrame, replaced: DataFrame) -> DataFrame:
    """Distinct (path, wanted) of requirements whose version isn't the selected one, replaced paths left out.

    ``edges`` (to_path, to_version, wanted); ``replaced`` (path).
    """
    bad = edges.where((F.col("wanted") != "") & (F.col("wanted") != F.col("to_version")))
    return bad.select(F.col("to_path").alias("path"), "wanted").distinct().join(replaced.select("path"), "path", "left_anti")


def fan_in(edges: DataFrame) -> DataFrame:
    """(node, external, internal): how many distinct callers of each kind a node has. ``edges``: src, dst, external."""
    return edges.select("src", "dst", "external").distinct().groupBy(F.col("dst").alias("node")).agg(F.count_if("external").alias("external"), F.count_if(~F.col("external")).alias("internal"))


def implementers(implementations: DataFrame, interface: str) -> DataFrame:
    """(type, declared): types of an interface. No row: the interface isn't known; a row with a null type: it has none."""
    of = implementations.where(F.col("interface") == interface)
    types = of.where("type is not null").select("type").distinct()
    empty = of.where("type is null").select("type").distinct()
    return types.unionByName((empty if types.isEmpty() else empty.where(F.lit(False)))).withColumn("declared", F.lit(True))


def devirtualise(edges: DataFrame, implementations: DataFrame) -> DataFrame:
    """Edges to an interface with exactly one type go to that type instead, as Direct; others stay."""
    single = implementations.where("type is not null").groupBy("interface").agg(F.countDistinct("type").alias("n"), F.min("type").alias("only")).where("n = 1")
    x = edges.join(single.select(F.col("interface").alias("dst"), "only"), "dst", "left")
    return x.select("src", F.coalesce("only", "dst").alias("dst"), F.when(F.col("only").isNotNull(), "Direct").otherwise(F.col("confidence")).alias("confidence"))


def satisfied(required: DataFrame, provided: DataFrame) -> DataFrame:
    """Relational division: (interface, type) of types that provide every method the interface requires.

    ``required`` (interface, method), ``provided`` (type, method). Interfaces without methods have no row.
    """
    need = required.distinct()
    size = need.groupBy("interface").agg(F.count("*").alias("need"))
    got = need.join(provided.distinct(), "method").groupBy("interface", "type").agg(F.count("*").alias("got"))
    return got.join(size, "interface").where("got = need").select("interface", "type")


def newest_major(known: DataFrame, family: DataFrame, limit: int = 32) -> DataFrame:
    """(stem, last): the last major of the unbroken run of majors known above ``base``, at most ``limit`` on; null if there is none.

    ``known`` (stem, major), ``family`` (stem, base).
    """
    above = family.join(known.distinct(), "stem", "left").where((F.col("major") > F.col("base")) & (F.col("major") <= F.col("base") + limit))
    w = Window.partitionBy("stem").orderBy("major")
    run = above.withColumn("_n", F.row_number().over(w)).where(F.col("major") == F.col("base") + F.col("_n"))
    return family.select("stem").distinct().join(run.groupBy("stem").agg(F.max("major").alias("last")), "stem", "left")


def reachability(edges: DataFrame, roots: DataFrame, findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(finding, is_reachable): whether a root reaches any of a finding's symbols (finding, symbol).

    Null where none of its symbols is a node of the graph: nothing was measured then.
    """
    seen = levels(edges, roots).select(F.col("node").alias("symbol"), F.lit(True).alias("_seen"))
    known = nodes.select(F.col("node").alias("symbol"), F.lit(True).alias("_known")).distinct()
    x = findings.select("finding", "symbol").join(known, "symbol", "left").join(seen, "symbol", "left")
    return x.groupBy("finding").agg(F.max(F.when(F.col("_known"), F.coalesce("_seen", F.lit(False)))).alias("is_reachable"))


def capabilities(paths: DataFrame, sinks: DataFrame) -> DataFrame:
    """(capability, sink, rank, depth): the best finding of each: the strongest path, the shortest, the smallest sink.

    ``paths`` as :func:`widest_paths` returns; ``sinks`` (node, capability).
    """
    x = paths.join(sinks, "node")
    w = Window.partitionBy("capability").orderBy(F.col("rank").desc(), "depth", "node")
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("capability", F.col("node").alias("sink"), "rank", "depth")


def stitched(*edge_sets: DataFrame) -> DataFrame:
    """One graph of many modules' edges (src, dst, confidence), the strongest confidence of repeated ones."""
    out = edge_sets[0].select("src", "dst", "confidence")
    for e in edge_sets[1:]:
        out = out.unionByName(e.select("src", "dst", "confidence"))
    return out.groupBy("src", "dst").agg(confidence_name(F.max(confidence_rank(F.col("confidence")))).alias("confidence"))


def entry_ancestry(edges: DataFrame, target: str, entries: DataFrame) -> DataFrame:
    """(entry, hops, weakest, via_reference): the nearest entries that reach the target backwards, by their best path of that many hops.

    ``edges`` (src, dst, rank, and reference where some edges are references, not calls; null counts as a call). A path of calls alone beats any
    with a reference; then the strongest weakest edge counts. Unbounded; it ends at the first level that holds an entry.
    """
    spark = edges.sparkSession
    _checkpoints(spark)
    reference = F.coalesce(F.col("reference"), F.lit(False)) if "reference" in edges.columns else F.lit(False)
    # a call and a reference between the same two nodes stay two edges
    back = edges.groupBy(F.col("dst").alias("d"), F.col("src").alias("s"), (~reference).alias("call")).agg(F.max("rank").alias("r")).checkpoint()
    frontier = spark.createDataFrame([(target, True, 4)], "node string, calls boolean, weakest int").checkpoint()
    seen, hops = frontier.select("node"), 0
    while True:
        hit = frontier.join(entries.select("node").distinct(), "node", "left_semi")
        if not hit.isEmpty() or frontier.isEmpty():
            return hit.select(F.col("node").alias("entry"), F.lit(hops).alias("hops"), "weakest", (~F.col("calls")).alias("via_reference"))
        hops += 1
        best = F.max(F.struct((F.col("calls") & F.col("call")).alias("calls"), F.least("weakest", "r").alias("weakest")))
        step = frontier.join(back, F.col("node") == F.col("d")).groupBy(F.col("s").alias("node")).agg(best.alias("best")).select("node", "best.*")
        frontier = step.join(seen, "node", "left_anti").checkpoint()
        seen = _grown(seen, frontier.select("node"), hops)
