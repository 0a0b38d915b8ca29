"""The remaining queries over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from depquarry.functions import classify, licence, text
from depquarry.operators import compose, diff, graph, joins, rollup
from depquarry.plans import oracle as o
from depquarry.plans.carriers import carrier, cte
from depquarry.plans.queries import RUNG, _roots, query, t
from depquarry.sources import store

C = F.col


def _node(prefix, column):
    return F.concat(F.lit(prefix), C(column).cast("string"))


# ---- sources and sinks -------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0")
def src_03_point_read(spark, sf_dir):
    """Every seventh order is altered after its hash was stored."""
    row = F.struct("o_orderkey", "o_custkey", "o_orderstatus")
    x = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").withColumn("hash", text.canonical_hash(row))
    x = x.withColumn("o_orderstatus", F.when(C("o_orderkey") % 7 == 0, "altered").otherwise(C("o_orderstatus")))
    return store.verified(x, row, "hash").drop("hash")


@query("SELECT event_id, ts, value FROM events WHERE user_id = 8 AND event_type = 'view'")
def src_04_generations(spark, sf_dir):
    return store.generations(t(spark, sf_dir, "events"), {"user_id": 8, "event_type": "view"}, ["ts", "event_id"]).select("event_id", "ts", "value")


@query("""SELECT '{"c_custkey":' || CAST(c_custkey AS STRING) || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS line FROM customer""")
def snk_06_json_lines(spark, sf_dir):
    return store.reread_json_lines(t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), graph.shared_path(spark, "lines"))


# ---- filters -----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_orderstatus <> 'P' AS cacheable, o_orderpriority NOT IN ('1-URGENT') AS fetched FROM orders""")
def flt_19_cacheable_and_fetched(spark, sf_dir):
    lookup = F.when(C("o_orderstatus") == "P", "failed").otherwise("ok")
    source = F.when(C("o_orderpriority") == "1-URGENT", "stdlib").when(C("o_orderpriority") == "2-HIGH", "odd").otherwise("proxy")
    return t(spark, sf_dir, "orders").select("o_orderkey", classify.is_cacheable(lookup).alias("cacheable"), classify.has_fetched_artefact(source).alias("fetched"))


# ---- joins -------------------------------------------------------------------------------------------


@query(cte("mods", "advisories") + f""", k AS (SELECT DISTINCT path, version FROM mods), i AS (SELECT id, path, CASE WHEN id < 'Brand#2' THEN '' ELSE '1.7.2' END AS fixed FROM advisories)
SELECT k.path, k.version, i.id FROM k JOIN i ON i.path = k.path WHERE i.fixed = '' OR NOT {o.valid('k.version')} OR {o.key('k.version')} < {o.key("'v1.7.2'")}""")
def jon_08_index_interval(spark, sf_dir):
    i = carrier(spark, sf_dir, "advisories").withColumn("fixed", F.when(C("id") < "Brand#2", "").otherwise("1.7.2"))
    m = carrier(spark, sf_dir, "mods").select("path", "version").distinct()
    # "latest" has no order, so it counts as affected
    return joins.with_ranges(m, i.select("id", "path", F.lit("").alias("lo"), C("fixed").alias("hi"))).where("inside").select("path", "version", "id")


# ---- graphs ------------------------------------------------------------------------------------------


@query(cte("deps", recursive=True) + """, b(node) AS (SELECT 'o7' UNION SELECT dst FROM b JOIN deps ON src = node)
SELECT s_suppkey AS finding, 's' || CAST(s_suppkey AS STRING) IN (SELECT node FROM b) AS path_found FROM supplier WHERE s_acctbal < 5000""")
def grf_22_negatives_searched_again(spark, sf_dir):
    e = carrier(spark, sf_dir, "deps")
    stored = t(spark, sf_dir, "supplier").select(C("s_suppkey").alias("finding"), _node("s", "s_suppkey").alias("symbol"), (C("s_acctbal") >= 5000).alias("reachable")).where(~C("reachable"))
    return graph.reachability(e, _roots(spark, "o7"), stored, stored.select(C("symbol").alias("node"))).select("finding", C("is_reachable").alias("path_found"))


# ---- roll-ups ----------------------------------------------------------------------------------------


@query(cte("gens") + """ SELECT DISTINCT module FROM (SELECT *, row_number() OVER (PARTITION BY module, source ORDER BY taken DESC, event_id) AS n FROM gens) WHERE n = 1 AND findings = 'Affected'""")
def agg_21_affected_modules(spark, sf_dir):
    return compose.served(carrier(spark, sf_dir, "gens"), ["module", "source"], [C("taken").desc(), C("event_id").asc()]).where("findings = 'Affected'").select("module").distinct()


# ---- composition, order ------------------------------------------------------------------------------


@query(cte("mods") + """ SELECT id, path, version, row_number() OVER (ORDER BY path, version, id) AS place FROM mods""")
def srt_01_node_order(spark, sf_dir):
    return rollup.placed(carrier(spark, sf_dir, "mods").select("id", "path", "version"), ["path", "version", "id"])


@query("""SELECT o_custkey AS module, list(o_orderkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS findings FROM orders GROUP BY o_custkey""")
def srt_03_findings_in_order(spark, sf_dir):
    key = F.struct("o_orderpriority", (-F.unix_micros(C("o_orderdate").cast("timestamp"))).alias("d"), "o_orderkey")
    g = t(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("module")).agg(F.sort_array(F.collect_list(key)).alias("l"))
    return g.select("module", F.transform("l", lambda x: x.o_orderkey).alias("findings"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS n, count(*) OVER () AS k FROM orders) WHERE n > k // 2")
def srt_07_skip(spark, sf_dir):
    """The lesser half of all orders."""
    orders = t(spark, sf_dir, "orders").select("o_orderkey")
    return rollup.page(orders, [C("o_orderkey").desc()], 0, orders.count() // 2)


@query("""WITH w AS (SELECT o_custkey AS project, o_orderkey AS walk, o_orderdate AS taken, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n, o_orderstatus = 'F' AS agrees FROM orders)
SELECT project, walk, agrees FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY agrees DESC, n) AS k FROM w WHERE n <= 5) WHERE k = 1""")
def srt_10_chosen_walk(spark, sf_dir):
    newest = F.row_number().over(Window.partitionBy("project").orderBy(C("taken").desc(), C("walk").desc()))
    w = t(spark, sf_dir, "orders").select(C("o_custkey").alias("project"), C("o_orderkey").alias("walk"), C("o_orderdate").alias("taken"), (C("o_orderstatus") == "F").alias("agrees")).withColumn("n", newest).where("n <= 5")
    return compose.served(w, ["project"], [C("agrees").desc(), C("n").asc()]).select("project", "walk", "agrees")


# ---- functions ---------------------------------------------------------------------------------------


@query(cte("licences") + """ SELECT id, CASE WHEN expression <> '' THEN expression WHEN id % 2 = 0 THEN target ELSE 'NOASSERTION' END AS clause FROM licences""")
def fn_28_licence_clause(spark, sf_dir):
    return carrier(spark, sf_dir, "licences").select("id", classify.licence_clause(C("expression"), F.when(C("id") % 2 == 0, C("target"))).alias("clause"))


@query(cte("gens") + """ SELECT event_id, CASE WHEN findings = 'Affected' THEN CAST(module AS STRING) || ' affected' WHEN findings = 'Withdrawn' THEN 'withdrawn only' WHEN coverage = 'Analysed' THEN 'clean' ELSE 'gap: ' || lower(coverage) END AS cell FROM gens""")
def fn_41_audit_cell(spark, sf_dir):
    return carrier(spark, sf_dir, "gens").select("event_id", classify.audit_cell(C("findings"), C("coverage"), C("module")).alias("cell"))


@query(cte("mods") + f""" SELECT id, CASE WHEN (NOT {o.valid('version')} OR contains(version, '-') OR contains(version, '+incompatible')) AND {o.valid('version')} AND {o.key('version')} > {o.key("'v1.3.0'")} THEN 'v1.3.0' ELSE 'v9.0.0' END AS against FROM mods""")
def x_11_tag_position(spark, sf_dir):
    return carrier(spark, sf_dir, "mods").select("id", classify.tag_position(C("version"), F.lit("v9.0.0"), F.lit("v1.3.0")).alias("against"))


# ---- commands ----------------------------------------------------------------------------------------


@query(cte("deps") + """, w AS (SELECT o_orderkey AS walk, o_orderdate AS taken FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50), k AS (SELECT l_partkey AS p FROM lineitem WHERE l_orderkey = (SELECT walk FROM w WHERE walk IN (SELECT l_orderkey FROM lineitem) ORDER BY taken DESC, walk DESC LIMIT 1))
SELECT DISTINCT src AS node FROM deps WHERE dst IN (SELECT 'p' || CAST(p AS STRING) FROM k)""")
def cmd_02_dependents(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")
    w = t(spark, sf_dir, "orders").select(C("o_orderkey").alias("walk"), C("o_orderdate").alias("taken"))
    last = joins.last_containing(w, l.select(C("l_orderkey").alias("walk")))
    targets = l.join(F.broadcast(last), C("l_orderkey") == C("walk"), "left_semi").select(_node("p", "l_partkey").alias("dst"))
    return carrier(spark, sf_dir, "deps").join(targets, "dst", "left_semi").select(C("src").alias("node")).distinct()


@query(cte("deps", recursive=True) + """, a(node) AS (SELECT 'o7' UNION SELECT dst FROM a JOIN deps ON src = node), b(node) AS (SELECT 'o8' UNION SELECT dst FROM b JOIN deps ON src = node),
x AS (SELECT list(DISTINCT node) AS l FROM a WHERE node LIKE 's%'), y AS (SELECT list(DISTINCT node) AS l FROM b WHERE node LIKE 's%')
SELECT list_sort(list_filter(y.l, lambda v: NOT list_contains(x.l, v))) AS added, list_sort(list_filter(x.l, lambda v: NOT list_contains(y.l, v))) AS removed, list_sort(list_filter(x.l, lambda v: list_contains(y.l, v))) AS common FROM x, y""")
def cmd_05_capability_diff(spark, sf_dir):
    e = carrier(spark, sf_dir, "deps", distinct=False)
    of = lambda n: graph.reachable(e, _roots(spark, n)).where(C("node").startswith("s")).select("node", F.lit(n).alias("side"))
    both = of("o7").union(of("o8")).agg(*[F.collect_set(F.when(C("side") == n, C("node"))).alias(n) for n in ("o7", "o8")])
    return both.select(diff.list_diff(C("o7"), C("o8")).alias("d")).select("d.*")


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'election' WHEN 1 THEN 'split' WHEN 2 THEN 'bundled' ELSE 'unstated' END AS shape, CASE p_size % 5 WHEN 2 THEN ['MIT'] WHEN 4 THEN ['MIT'] ELSE ['ISC', 'MIT'] END AS own, CASE WHEN p_size % 5 = 2 THEN ['ISC'] ELSE [] END AS bundled FROM part""")
def fn_22_compound_reading(spark, sf_dir):
    mit, isc = "Permission is hereby granted, free of charge\n", "Permission to use, copy, modify, and/or distribute this software\n"
    s = C("p_size") % 5
    body = F.when(s == 0, "SPDX-License-Identifier: MIT OR ISC\n" + mit + isc).when(s == 1, "The following files are ISC\n" + mit + isc).when(s == 2, mit + "\nCopyright 2020 B\n" + isc).otherwise(mit + isc)
    ids = F.when(s == 4, F.array(F.lit("MIT"))).otherwise(F.array(F.lit("MIT"), F.lit("ISC")))
    return t(spark, sf_dir, "part").select("p_partkey", licence.compound_reading(body, ids).alias("r")).select("p_partkey", "r.*")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'linux/amd64' WHEN o_orderpriority = '1-URGENT' THEN 'unrecorded' ELSE 'not-platform-scoped' END AS text, CASE WHEN o_orderstatus = 'F' THEN 'platform' WHEN o_orderpriority = '1-URGENT' THEN 'unrecorded' ELSE 'not-platform-scoped' END AS basis FROM orders""")
def fn_40_walk_frame(spark, sf_dir):
    f = C("o_orderstatus") == "F"
    frame = classify.walk_frame(F.when(f, "linux"), F.when(f, "amd64").otherwise(""), C("o_orderpriority") != "1-URGENT")
    return t(spark, sf_dir, "orders").select("o_orderkey", frame.alias("f")).select("o_orderkey", "f.*")


@query("""SELECT p_partkey AS version, CASE WHEN p_size % 3 = 0 THEN 'src' || CAST(p_partkey AS STRING) END AS filename, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'source file missing' ELSE 'release not found' END AS problem FROM part""")
def x_14_release_source(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    file = lambda kind: F.struct(F.concat(F.lit("src"), C("p_partkey").cast("string")).alias("filename"), F.lit(kind).alias("kind"), F.lit("00").alias("sha256"))
    releases = p.where("p_size % 3 < 2").select(C("p_partkey").alias("version"), F.when(C("p_size") % 3 == 0, F.array(file("archive"), file("source"))).otherwise(F.array(file("archive"))).alias("files"))
    return store.source_checksums(p.select(C("p_partkey").alias("version")), releases).select("version", "filename", "problem")


@query(cte("gens") + """ SELECT event_id, source <> 'click' AND source <> 'view' AND (confidence > 50 OR (source = 'error' AND coverage = 'Failed')) AS again FROM gens""")
def x_17_reanalysis(spark, sf_dir):
    offered = F.when(C("source") != "click", "list-a").otherwise("")
    recorded = F.when(C("source") == "view", "list-a").when(C("source") == "error", "").otherwise("list-b")
    again = classify.pinned_analysis_supersedes(offered, recorded, F.when(C("confidence") > 50, 3).otherwise(0), C("coverage") == "Failed")
    return carrier(spark, sf_dir, "gens").select("event_id", again.alias("again"))
