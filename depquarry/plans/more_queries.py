"""Further queries over the test tables, after :mod:`depquarry.plans.queries`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from depquarry.functions import classify, licence, semver, text
from depquarry.operators import compose, diff, graph, joins, resolve, rollup
from depquarry.plans import oracle as o
from depquarry.plans.carriers import carrier, cte
from depquarry.plans.queries import RANK, RUNG, _roots, query, t

C = F.col


# ---- joins ------------------------------------------------------------------------------------------


@query(cte("gens") + """ SELECT event_id FROM gens r WHERE NOT EXISTS (SELECT 1 FROM gens x WHERE x.module = r.module AND x.source = r.source AND x.identity = r.identity AND x.taken > r.taken)""")
def jon_05_newest_by_not_exists(spark, sf_dir):
    return compose.latest_with_ties(carrier(spark, sf_dir, "gens"), ["module", "source", "identity"], "taken").select("event_id")


@query("""SELECT o_custkey AS run, 'm' || CAST(o_orderkey % 7 AS STRING) AS path, 'v' || CAST(o_orderkey AS STRING) || '@x' AS version, o_orderstatus AS hash FROM orders""")
def jon_06_exploded_results(spark, sf_dir):
    k = F.concat(F.lit("m"), (C("o_orderkey") % 7).cast("string"), F.lit("@v"), C("o_orderkey").cast("string"), F.lit("@x"))
    runs = t(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("run")).agg(F.map_from_entries(F.collect_list(F.struct(k, "o_orderstatus"))).alias("results"))
    return joins.exploded_results(runs, "run", "results")


@query(cte("mods", "range_events") + f""", n AS (SELECT *, lead(kind) OVER w AS nk, lead(version) OVER w AS nv FROM range_events WINDOW w AS (PARTITION BY id, path ORDER BY position)),
i AS (SELECT id, path, version AS lo, CASE WHEN nk = 'fixed' THEN nv END AS hi FROM n WHERE kind = 'introduced'), k AS (SELECT DISTINCT path, CASE WHEN version = 'latest' THEN 'vlatest' ELSE version END AS version FROM mods)
SELECT k.path, k.version, i.id, CASE WHEN NOT {o.valid('k.version')} THEN 'unjudgeable' WHEN i.id = 'Brand#5' THEN 'withdrawn' WHEN bool_or((i.lo = '0' OR {o.key(o.prefixed('i.lo'))} <= {o.key('k.version')}) AND (i.hi IS NULL OR {o.key('k.version')} < {o.key(o.prefixed('i.hi'))})) THEN 'affected' ELSE 'not affected' END AS verdict
FROM k JOIN i ON i.path = k.path GROUP BY k.path, k.version, i.id""")
def jon_11_toolchain_judged(spark, sf_dir):
    m = carrier(spark, sf_dir, "mods").select("path", F.when(C("version") == "latest", "vlatest").otherwise(C("version")).alias("version"))
    return joins.judged(m, joins.intervals(carrier(spark, sf_dir, "range_events"), ["id", "path"]), spark.createDataFrame([("Brand#5",)], "id string"))


@query("""SELECT documents.doc_id, CASE WHEN labels.doc_id IS NULL THEN 'unmeasured' WHEN quality = 0 THEN 'unclassified' ELSE 'classified' END AS measurement FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id""")
def jon_12_measurement(spark, sf_dir):
    l = t(spark, sf_dir, "labels").select("doc_id", F.when(C("quality") == 0, "").otherwise("MIT").alias("spdx"))
    return joins.with_measurement(t(spark, sf_dir, "documents").select("doc_id"), l, ["doc_id"], "spdx").select("doc_id", "measurement")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'x/m.T' ELSE 'x/m' END AS prefix FROM part""")
def jon_17_symbol_prefix(spark, sf_dir):
    s = F.when(C("p_size") % 3 == 0, F.concat(F.lit("x/m.T.f"), C("p_partkey").cast("string"))).otherwise(F.concat(F.lit("x/m/sub.f"), C("p_partkey").cast("string")))
    p = spark.createDataFrame([("x/m",), ("x/m.T",), ("x/m/su",)], "prefix string")
    return joins.longest_prefix(t(spark, sf_dir, "part").select("p_partkey", s.alias("symbol")), "symbol", p, "prefix", "./").select("p_partkey", "prefix")


@query(cte("gens") + f""", f AS (SELECT module, event_id, row_number() OVER (PARTITION BY module ORDER BY {RUNG} DESC, taken DESC, event_id) AS n FROM gens) SELECT e.event_id, e.user_id, e.event_type FROM events e JOIN f ON f.event_id = e.event_id WHERE f.n = 1""")
def jon_22_served_only(spark, sf_dir):
    rung = compose.rank_of(C("completeness"), compose.COMPLETENESS)
    served = compose.served(carrier(spark, sf_dir, "gens"), ["module"], [rung.desc(), C("taken").desc(), C("event_id").asc()])
    return t(spark, sf_dir, "events").join(served.select("event_id"), "event_id", "left_semi").select("event_id", "user_id", "event_type")


@query(cte("mods") + f""", n AS (SELECT path, version FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {o.key('version')} DESC NULLS LAST, version DESC) AS k FROM mods) WHERE k = 1)
SELECT path, version FROM n WHERE path IN (SELECT 'example.com/m' || CAST(s_suppkey % 15 AS STRING) FROM supplier)""")
def x_08_require_pins(spark, sf_dir):
    imports = t(spark, sf_dir, "supplier").select(F.concat(F.lit("example.com/m"), (C("s_suppkey") % 15).cast("string"), F.lit("/pkg")).alias("name"))
    return joins.pins(carrier(spark, sf_dir, "mods").select("path", "version").distinct(), imports)


# ---- graphs -----------------------------------------------------------------------------------------


@query(cte("deps", recursive=True) + """, b(node) AS (SELECT 'o7' UNION SELECT dst FROM b JOIN deps ON src = node), s AS (SELECT l_suppkey % 40 AS finding, 's' || CAST(l_suppkey AS STRING) AS symbol FROM lineitem UNION SELECT 1000 + p_partkey % 10, CASE WHEN p_partkey % 10 = 3 THEN 'none' ELSE 'p' || CAST(p_partkey AS STRING) END FROM part),
k AS (SELECT src AS node FROM deps UNION SELECT dst FROM deps)
SELECT finding, bool_or(CASE WHEN symbol IN (SELECT node FROM k) THEN symbol IN (SELECT node FROM b) END) AS is_reachable FROM s GROUP BY finding""")
def grf_21_reachability(spark, sf_dir):
    e = carrier(spark, sf_dir, "deps", distinct=False)
    s = t(spark, sf_dir, "lineitem").select((C("l_suppkey") % 40).alias("finding"), F.concat(F.lit("s"), C("l_suppkey").cast("string")).alias("symbol"))
    p = t(spark, sf_dir, "part").select((1000 + C("p_partkey") % 10).alias("finding"), F.when(C("p_partkey") % 10 == 3, "none").otherwise(F.concat(F.lit("p"), C("p_partkey").cast("string"))).alias("symbol"))
    return graph.reachability(e, _roots(spark, "o7"), s.union(p).distinct(), e.select(C("src").alias("node")).union(e.select("dst")))


@query(cte("deps", recursive=True) + f""", b(node, rank) AS (SELECT 'o7', 5 UNION SELECT dst, least(rank, {RANK}) FROM b JOIN deps ON src = node), w AS (SELECT node, max(rank) AS rank FROM b GROUP BY node)
SELECT n_name AS capability, max(rank) AS rank FROM w JOIN nation ON node = 'n' || CAST(n_nationkey AS STRING) GROUP BY n_name""")
def grf_23_capabilities(spark, sf_dir):
    e = carrier(spark, sf_dir, "deps", distinct=False).select("src", "dst", graph.confidence_rank(C("confidence")).alias("rank"))
    sinks = t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), C("n_nationkey").cast("string")).alias("node"), C("n_name").alias("capability"))
    return graph.capabilities(graph.widest_paths(e, _roots(spark, "o7")), sinks).select("capability", "rank")


@query(cte("deps") + f""" SELECT src, dst, CASE max({RANK}) WHEN 4 THEN 'Direct' WHEN 3 THEN 'VTA' WHEN 2 THEN 'Framework' WHEN 1 THEN 'CHA-overapprox' ELSE 'Unknown' END AS confidence FROM deps GROUP BY src, dst""")
def grf_26_stitched(spark, sf_dir):
    e = carrier(spark, sf_dir, "deps")
    return graph.stitched(e.where(C("src").startswith("o")), e.where(~C("src").startswith("o")), e.where(C("dst").startswith("n")))


@query(cte("deps", recursive=True) + f""", b(node, d, w) AS (SELECT 'n3', 0, 4 UNION SELECT src, d + 1, least(w, {RANK}) FROM b JOIN deps ON dst = node WHERE d < 4), h AS (SELECT node, min(d) AS d FROM b WHERE node LIKE 'o%' GROUP BY node), m AS (SELECT min(d) AS d FROM h)
SELECT b.node AS entry, b.d AS hops, max(w) AS weakest FROM b JOIN m ON b.d = m.d WHERE node LIKE 'o%' GROUP BY b.node, b.d""")
def x_05_entry_ancestry(spark, sf_dir):
    e = carrier(spark, sf_dir, "deps").select("src", "dst", graph.confidence_rank(C("confidence")).alias("rank"))
    return graph.entry_ancestry(e, "n3", t(spark, sf_dir, "orders").select(F.concat(F.lit("o"), C("o_orderkey").cast("string")).alias("node"))).select("entry", "hops", "weakest")


@query(cte("deps", recursive=True) + f""", e AS (SELECT src, dst, {RANK} AS r, confidence = 'VTA' AND src LIKE 'c%' AND CAST(substr(src, 2) AS BIGINT) % 2 = 0 AS ref FROM deps), b(node, d, ref, w) AS (SELECT 'n3', 0, false, 4 UNION SELECT src, d + 1, b.ref OR e.ref, least(w, r) FROM b JOIN e ON dst = node WHERE d < 4), h AS (SELECT min(d) AS d FROM b WHERE node LIKE 'o%'), k AS (SELECT b.*, row_number() OVER (PARTITION BY node ORDER BY ref, w DESC) AS n FROM b JOIN h ON b.d = h.d WHERE node LIKE 'o%')
SELECT node AS entry, d AS hops, w AS weakest, ref AS via_reference FROM k WHERE n = 1""")
def x_05_entry_ancestry_references(spark, sf_dir):
    reference = (C("confidence") == "VTA") & C("src").startswith("c") & (F.substring("src", 2, 20).try_cast("long") % 2 == 0)
    e = carrier(spark, sf_dir, "deps").select("src", "dst", graph.confidence_rank(C("confidence")).alias("rank"), reference.alias("reference"))
    return graph.entry_ancestry(e, "n3", t(spark, sf_dir, "orders").select(F.concat(F.lit("o"), C("o_orderkey").cast("string")).alias("node")))


# ---- roll-ups, composition ----------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM lineitem")
def agg_02_count(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query(cte("licences") + """, i AS (SELECT id, trim(unnest(string_split_regex(expression, ' (OR|AND) '))) AS spdx FROM licences)
SELECT spdx, count(DISTINCT id % 40) AS modules FROM i WHERE spdx <> '' AND spdx NOT IN ('MIT', 'Apache-2.0', 'GPL-2.0', 'GPL-2.0-or-later', 'GPL-3.0-only', 'MPL-2.0', 'AGPL-3.0-only', 'BSD-3-Clause') GROUP BY spdx""")
def agg_09_coverage_holes(spark, sf_dir):
    i = carrier(spark, sf_dir, "licences").select("id", F.explode(F.split("expression", " (OR|AND) ")).alias("spdx"))
    return i.where((C("spdx") != "") & licence.strength(C("spdx")).isNull()).groupBy("spdx").agg(F.countDistinct(C("id") % 40).alias("modules"))


@query(cte("gens") + """ SELECT module, identity, event_id FROM (SELECT *, row_number() OVER (PARTITION BY module, identity ORDER BY taken DESC, event_id) AS n FROM gens) WHERE n = 1""")
def cmp_02_worktree(spark, sf_dir):
    return compose.served(carrier(spark, sf_dir, "gens"), ["module", "identity"], [C("taken").desc(), C("event_id").asc()]).select("module", "identity", "event_id")


@query(cte("gens") + """, r AS (SELECT *, CASE coverage WHEN 'Analysed' THEN 2 WHEN 'Unscannable' THEN 1 ELSE 0 END AS rank FROM gens), m AS (SELECT *, max(rank) OVER (PARTITION BY module) AS top FROM r),
c AS (SELECT module, count(DISTINCT nullif(identity, '')) AS ids, count(DISTINCT CASE WHEN rank = top THEN source END) AS contents FROM m GROUP BY module), f AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY rank DESC, taken DESC, event_id) AS n FROM m)
SELECT f.module, f.event_id, CASE WHEN ids > 1 THEN 'identity' WHEN contents > 1 THEN 'content' END AS conflict FROM f JOIN c ON c.module = f.module WHERE n = 1""")
def cmp_03_interface(spark, sf_dir):
    g = carrier(spark, sf_dir, "gens").withColumn("coverage", F.when(C("coverage") == "Analysed", "Extracted").when(C("coverage") == "Unscannable", "Partial").otherwise("Failed"))
    r = compose.interface_ranking(C("coverage"), C("taken"), C("event_id"))
    top = compose.rank_of(C("coverage"), ("Partial", "Extracted"))
    return compose.served(g, ["module"], r, C("identity"), C("source"), top).select("module", "event_id", "conflict")


@query(cte("gens") + """ SELECT module, event_id FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY (coverage = 'Failed'), (completeness = 'TypeOnly'), CASE source WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 0 END DESC, findings DESC, taken DESC, event_id) AS n FROM gens) WHERE n = 1""")
def cmp_08_fetch(spark, sf_dir):
    strength = F.when(C("source") == "error", "cross-verified").when(C("source") == "purchase", "checksum db").when(C("source") == "click", "go.sum").when(C("source") == "view", "local").otherwise("odd")
    r = compose.fetch_ranking(C("coverage") == "Failed", C("completeness") == "TypeOnly", strength, C("findings"), C("taken"), C("event_id"))
    return compose.served(carrier(spark, sf_dir, "gens"), ["module"], r).select("module", "event_id")


@query(cte("gens") + """ SELECT module, event_id FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY (coverage = 'Analysed') DESC, CAST(floor(confidence) AS BIGINT), taken DESC, event_id) AS n FROM gens) WHERE n = 1""")
def cmp_10_example(spark, sf_dir):
    r = [(C("coverage") == "Analysed").desc(), F.floor("confidence").asc(), C("taken").desc(), C("event_id").asc()]
    return compose.served(carrier(spark, sf_dir, "gens"), ["module"], r).select("module", "event_id")


@query("""SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 1""")
def srt_08_latest(spark, sf_dir):
    return rollup.page(t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), [C("p_size").desc(), C("p_partkey")], 1)


@query("""WITH x AS (SELECT o_custkey AS k, list('o' || CAST(o_orderkey AS STRING) ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey)
SELECT k, CASE WHEN len(l) <= 6 THEN array_to_string(l, ' -> ') ELSE array_to_string(l[1:5], ' -> ') || ' -> … (' || CAST(len(l) - 6 AS STRING) || ' more) -> ' || l[-1] END AS route FROM x""")
def srt_12_route_summary(spark, sf_dir):
    x = t(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("k")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("l"))
    return x.select("k", text.route_summary(F.transform("l", lambda i: F.concat(F.lit("o"), i.cast("string")))).alias("route"))


# ---- differences --------------------------------------------------------------------------------------


@query("""WITH old AS (SELECT p_brand AS package, p_type AS kind, p_name AS name, max(p_size) AS s FROM part WHERE p_size > 10 GROUP BY ALL), new AS (SELECT p_brand AS package, p_type AS kind, p_name AS name, max(p_size) AS s FROM part WHERE p_size < 40 GROUP BY ALL)
SELECT coalesce(o.package, n.package) AS package, coalesce(o.kind, n.kind) AS kind, coalesce(o.name, n.name) AS name, CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' WHEN o.s = n.s THEN 'spelling-only' ELSE 'changed' END AS change
FROM old o FULL OUTER JOIN new n ON o.package = n.package AND o.kind = n.kind AND o.name = n.name""")
def set_03_api_diff(spark, sf_dir):
    g = t(spark, sf_dir, "part").select(C("p_brand").alias("package"), C("p_type").alias("kind"), C("p_name").alias("name"), "p_size")
    of = lambda x, blank: x.groupBy("package", "kind", "name").agg(F.concat(F.lit("func(" + blank), F.max("p_size").cast("string"), F.lit(")")).alias("signature"))
    return diff.api_diff(of(g.where("p_size > 10"), ""), of(g.where("p_size < 40"), " "))


@query("""WITH m AS (SELECT o_custkey AS path, o_orderstatus AS frame, o_totalprice > 250000 AS s FROM orders WHERE o_totalprice > 100000)
SELECT c_custkey AS path, CASE WHEN bool_or(frame = 'F' AND NOT s) THEN 'covered' WHEN bool_or(frame <> 'F') THEN 'other frame' WHEN bool_or(frame = 'F' AND s) THEN 'superseded' ELSE 'none' END AS state FROM customer LEFT JOIN m ON path = c_custkey GROUP BY c_custkey""")
def set_13_verification_partition(spark, sf_dir):
    m = t(spark, sf_dir, "orders").where("o_totalprice > 100000").select(C("o_custkey").alias("path"), C("o_orderstatus").alias("frame"), (C("o_totalprice") > 250000).alias("superseded"))
    return diff.partition_coverage(t(spark, sf_dir, "customer").select(C("c_custkey").alias("path")), m, "F")


# ---- functions ----------------------------------------------------------------------------------------


@query(cte("mods") + f""" SELECT id, NOT {o.valid('version')} OR {o.key('version')} < {o.key("'v1.17'")} AS old, NOT {o.valid('version')} OR contains(version, '-') OR contains(version, '+incompatible') AS above, CASE WHEN {o.valid('version')} THEN 'v' || regexp_extract(version, '^v([0-9]+)', 1) END AS major FROM mods""")
def fn_02_pruning_and_tags(spark, sf_dir):
    v = C("version")
    bare = F.when(v == "latest", "latest").otherwise(F.substring(v, F.lit(2), F.length(v)))
    return carrier(spark, sf_dir, "mods").select("id", semver.before_pruning(bare).alias("old"), semver.can_sort_above_tag(v).alias("above"), semver.major(v).alias("major"))


@query(cte("range_events") + """, n AS (SELECT *, lead(version) OVER (PARTITION BY id, path ORDER BY position) AS hi FROM range_events) SELECT id, path, position, CASE WHEN hi IS NULL THEN '>= ' || version ELSE '>= ' || version || ', < ' || hi END AS affected FROM n WHERE kind = 'introduced'""")
def fn_05_affected_text(spark, sf_dir):
    hi = F.lead("version").over(Window.partitionBy("id", "path").orderBy("position"))
    x = carrier(spark, sf_dir, "range_events").withColumn("hi", hi).where("kind = 'introduced'")
    return x.select("id", "path", "position", semver.affected_text(C("version"), C("hi")).alias("affected"))


@query("""SELECT p_partkey, p_size % 2 = 0 AS pair, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'sub/q' END AS rel FROM part""")
def fn_09_major_pairs(spark, sf_dir):
    other = F.when(C("p_size") % 2 == 0, "x/m/v3").otherwise("x/n/v3")
    pkg = F.when(C("p_size") % 3 == 0, "x/m/v2").otherwise("x/m/v2/sub/q")
    return t(spark, sf_dir, "part").select("p_partkey", text.is_major_pair(F.lit("x/m/v2"), other).alias("pair"), text.relative_package(pkg, F.lit("x/m/v2")).alias("rel"))


@query("""SELECT p_partkey, 'pkg:golang/example.com/a%2Bb/' || CAST(p_partkey AS STRING) || '@v1.' || CAST(p_size AS STRING) || '.0%2Bincompatible' AS purl FROM part""")
def fn_15_package_url(spark, sf_dir):
    path = F.concat(F.lit("example.com/a+b/"), C("p_partkey").cast("string"))
    v = F.concat(F.lit("v1."), C("p_size").cast("string"), F.lit(".0+incompatible"))
    return t(spark, sf_dir, "part").select("p_partkey", text.package_url(path, v).alias("purl"))


@query(cte("licences") + """, x AS (SELECT id % 40 AS k, list_sort(list(DISTINCT expression) FILTER (WHERE expression NOT LIKE '% %' AND expression <> '')) AS l FROM licences GROUP BY ALL)
SELECT k, CASE WHEN l IS NULL THEN '' ELSE CASE WHEN k % 2 = 0 THEN array_to_string(l, ' OR ') ELSE array_to_string(l, ' AND ') END END AS expression FROM x""")
def fn_20_derived_expression(spark, sf_dir):
    x = carrier(spark, sf_dir, "licences").groupBy((C("id") % 40).alias("k")).agg(F.collect_set(licence.sole_identifier(C("expression"))).alias("l"))
    return x.select("k", licence.derived_expression(C("l"), C("k") % 2 == 0).alias("expression"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'unrooted' WHEN s_suppkey % 3 = 0 THEN 'test' WHEN s_acctbal > 8000 THEN 'ingress' WHEN s_acctbal > 4000 THEN 'exported' ELSE 'internal' END AS root, CASE WHEN s_nationkey % 3 = 0 THEN 'not measured' WHEN s_nationkey % 3 = 1 THEN 'reachable' ELSE 'not reachable' END AS reach FROM supplier""")
def fn_35_route_roots(spark, sf_dir):
    k, b, n = C("s_suppkey"), C("s_acctbal"), C("s_nationkey") % 3
    return t(spark, sf_dir, "supplier").select("s_suppkey", classify.route_root(k % 3 == 0, b > 8000, b > 4000, k % 5 != 0).alias("root"), classify.reachability(F.when(n != 0, n == 1)).alias("reach"))


@query(cte("deps") + f""" SELECT src, dst, {RANK} AS rank FROM deps""")
def fn_38_confidence_rank(spark, sf_dir):
    return carrier(spark, sf_dir, "deps").select("src", "dst", graph.confidence_rank(C("confidence")).alias("rank"))


@query("""SELECT page_id, regexp_matches(lower(url), '^https?://([^/?#]+[.])?example[.](org|net)([/:?#]|$)') AS trusted FROM pages""")
def fn_48_trusted_hosts(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", text.is_trusted_host(C("url"), ["example.org", "example.net"]).alias("trusted"))


@query("""SELECT p_partkey, p_size % 6 IN (0, 1, 2) AS licence, p_size % 6 NOT IN (1, 3) AS root FROM part""")
def x_04_licence_files(spark, sf_dir):
    s = C("p_size") % 6
    p = F.when(s == 0, "LICENSE").when(s == 1, "sub/COPYING.txt").when(s == 2, "MIT-LICENSE").when(s == 3, "vendor/x/README").when(s == 4, "licence.go").otherwise("notes.md")
    return t(spark, sf_dir, "part").select("p_partkey", licence.is_licence_file(p).alias("licence"), licence.is_root_level(p).alias("root"))


@query(cte("licences") + """, f AS (SELECT id % 60 AS k, expression AS spdx, (id % 7) / 10.0 AS c FROM licences WHERE id % 60 <> 5), top AS (SELECT k, arg_max(spdx, row(c, spdx)) AS spdx, count(*) AS n, count(DISTINCT spdx) AS kinds FROM f GROUP BY k)
SELECT k, CASE WHEN spdx = '' THEN 'Unclassified' WHEN kinds > 1 THEN 'Multiple' ELSE 'Detected' END AS status FROM top""")
def x_01_licence_status(spark, sf_dir):
    f = carrier(spark, sf_dir, "licences").select((C("id") % 60).alias("k"), C("expression").alias("spdx"), ((C("id") % 7) / 10.0).alias("confidence")).where("k <> 5")
    g = f.groupBy("k").agg(F.collect_list(F.struct("spdx", "confidence", F.lit(False).alias("is_per_file"), F.lit(False).alias("close_alternative"))).alias("files"))
    return g.select("k", licence.module_status(C("files")).alias("status"))


@query(cte("mods") + """ SELECT DISTINCT path, version FROM mods WHERE version LIKE '%+incompatible'""")
def x_15_pre_modules(spark, sf_dir):
    return carrier(spark, sf_dir, "mods").where(semver.build(C("version")) == "+incompatible").select("path", "version").distinct()


# ---- commands -----------------------------------------------------------------------------------------


@query(cte("mods", "licences", "gens") + f""", v AS (SELECT module, findings FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY (findings IN ('Affected', 'Withdrawn')) DESC, taken DESC, event_id) AS n FROM gens) WHERE n = 1),
x AS (SELECT m.id, m.version, l.expression, l.target, v.findings, CASE WHEN m.version = 'v1.5.0' THEN 'level' WHEN NOT {o.valid('m.version')} OR {o.key('m.version')} < {o.key("'v1.5.0'")} THEN 'behind' WHEN {o.key('m.version')} > {o.key("'v1.5.0'")} THEN 'ahead' ELSE 'level' END AS pin FROM mods m LEFT JOIN licences l ON l.id = m.id LEFT JOIN v ON v.module = m.id)
SELECT id, version, CASE WHEN expression = '' THEN 'unclassified' ELSE 'classified' END AS licence, coalesce(findings, 'not measured') AS vulnerability, pin, coalesce(findings = 'Affected', false) AS blocking FROM x""")
def cmd_01_audit(spark, sf_dir):
    m = carrier(spark, sf_dir, "mods").select("id", "version")
    m = joins.with_measurement(m, carrier(spark, sf_dir, "licences"), ["id"], "expression")
    v = compose.served(carrier(spark, sf_dir, "gens"), ["module"], [C("findings").isin("Affected", "Withdrawn").desc(), C("taken").desc(), C("event_id").asc()])
    x = m.join(v.select(C("module").alias("id"), "findings"), "id", "left")
    return x.select("id", "version", C("measurement").alias("licence"), F.coalesce("findings", F.lit("not measured")).alias("vulnerability"), semver.compare_pin(C("version"), F.lit("v1.5.0")).alias("pin"), F.coalesce(C("findings") == "Affected", F.lit(False)).alias("blocking"))


@query(cte("licences") + """, x AS (SELECT id, target, expression, unnest(CASE WHEN expression LIKE '% AND %' THEN string_split(expression, ' AND ') ELSE [expression] END) AS arm FROM licences),
v AS (SELECT *, CASE WHEN arm LIKE '% OR %' THEN CASE WHEN target = 'GPL-3.0-only' THEN 'compatible' ELSE 'electable' END WHEN arm IN ('CC-BY-4.0', '') THEN 'unknown_pair' WHEN arm IN ('MIT', 'Apache-2.0', 'MPL-2.0', 'BSD-3-Clause') THEN 'compatible' WHEN target IN ('MIT', 'Apache-2.0') THEN 'incompatible' WHEN arm = target THEN 'compatible' WHEN target = 'GPL-3.0-only' AND arm = 'GPL-2.0-or-later' THEN 'compatible' ELSE 'unknown_pair' END AS verdict FROM x)
SELECT target, verdict, count(DISTINCT id) AS modules FROM v WHERE verdict <> 'compatible' GROUP BY target, verdict""")
def cmd_06_licence_compatibility(spark, sf_dir):
    l = carrier(spark, sf_dir, "licences")
    x = l.select("id", "target", "expression", F.explode(F.coalesce(licence.arms(C("expression"), "AND"), F.array("expression"))).alias("arm"))
    either = licence.arms(C("arm"), "OR")
    v = F.when(either.isNotNull(), licence.election(either, C("target"))).otherwise(licence.compatibility(C("arm"), C("target")))
    return x.withColumn("verdict", v).where("verdict <> 'compatible'").groupBy("target", "verdict").agg(F.countDistinct("id").alias("modules"))


@query(cte("gens") + """, r AS (SELECT *, row_number() OVER (PARTITION BY module, source ORDER BY (findings IN ('Affected', 'Withdrawn')) DESC, (coverage = 'Analysed') DESC, taken DESC, event_id DESC) AS n FROM gens)
SELECT module, source, event_id, findings, coverage FROM r WHERE n = 1 AND findings = 'Affected'""")
def cmd_13_vuln_by_id(spark, sf_dir):
    r = [C("findings").isin("Affected", "Withdrawn").desc(), (C("coverage") == "Analysed").desc(), C("taken").desc(), C("event_id").desc()]
    return compose.served(carrier(spark, sf_dir, "gens"), ["module", "source"], r).where("findings = 'Affected'").select("module", "source", "event_id", "findings", "coverage")


@query(cte("mods") + f""", n AS (SELECT path, version FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {o.key('version')} DESC NULLS LAST, version DESC) AS k FROM mods) WHERE k = 1)
SELECT m.id, CASE WHEN m.version = n.version THEN 'level' WHEN NOT {o.valid('m.version')} OR NOT {o.valid('n.version')} OR {o.key('m.version')} < {o.key('n.version')} THEN 'behind' WHEN {o.key('m.version')} > {o.key('n.version')} THEN 'ahead' ELSE 'level' END AS pin FROM mods m JOIN n ON n.path = m.path""")
def cmd_16_latest(spark, sf_dir):
    m = carrier(spark, sf_dir, "mods")
    n = compose.served(m, ["path"], [semver.key(C("version")).desc_nulls_last(), C("version").desc()]).select("path", C("version").alias("newest"))
    return m.join(n, "path").select("id", semver.compare_pin(C("version"), C("newest")).alias("pin"))


# ---- further functions and commands ---------------------------------------------------------------------


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Client.Do' WHEN 1 THEN 'Client' WHEN 2 THEN 'helper' ELSE '' END AS symbol, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'second_Try' WHEN 2 THEN '' ELSE 'suffix' END AS suffix FROM part""")
def fn_13_example_symbol(spark, sf_dir):
    s = C("p_size") % 4
    f = F.when(s == 0, "ExampleClient_Do").when(s == 1, "ExampleClient_second_Try").when(s == 2, "helper").otherwise("Example_suffix")
    return t(spark, sf_dir, "part").select("p_partkey", classify.example_symbol(f).alias("x")).select("p_partkey", "x.*")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'x/y@v1.2.3' WHEN 1 THEN '' ELSE NULL END AS origin, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'no copyright' WHEN 2 THEN 'unterminated' ELSE NULL END AS error, CASE WHEN p_size % 4 = 3 THEN 0 ELSE 1 END AS n FROM part""".replace("ELSE NULL END AS origin", "WHEN 2 THEN '' END AS origin"))
def fn_18_snippet_blocks(spark, sf_dir):
    s = C("p_size") % 4
    head = "package p\n// SPDX-SnippetBegin\n// SPDX-License-Identifier: MIT\n"
    whole = head + "//\n// SPDX-SnippetCopyrightText: 2020 A\n// SPDX-SnippetComment: from x/y@v1.2.3 there\n// SPDX-SnippetEnd\nfunc f() {}\n"
    src = F.when(s == 0, whole).when(s == 1, head + "// SPDX-SnippetEnd\n").when(s == 2, head).otherwise("package p\n// plain\n")
    x = t(spark, sf_dir, "part").select("p_partkey", licence.snippets(src).alias("b"))
    return x.select("p_partkey", F.get("b", F.lit(0)).origin.alias("origin"), F.get("b", F.lit(0)).error.alias("error"), F.size("b").alias("n"))


@query(cte("gens") + """ SELECT event_id, CASE WHEN module % 3 = 0 OR module % 3 = 1 THEN 'NotStated' WHEN confidence < 30 THEN 'Unsearchable' WHEN source = 'error' THEN 'Disputed' WHEN module % 2 = 0 THEN CASE WHEN completeness = 'BuiltWithBodies' THEN 'Confirmed' ELSE 'Unconfirmed' END WHEN source = 'view' THEN CASE WHEN completeness = 'BuiltWithBodies' THEN 'Confirmed' ELSE 'Unconfirmed' END ELSE 'Unconfirmed' END AS rung FROM gens""")
def fn_36_negative_soundness(spark, sf_dir):
    m = C("module")
    found = F.when(C("source") == "error", True).when(C("source") == "view", False)
    rung = classify.negative_soundness(F.when(m % 3 != 0, m % 3 == 1), C("confidence") < 30, F.when(m % 2 == 0, "callgraph").otherwise("scanner"), C("completeness"), found, F.lit(True))
    return carrier(spark, sf_dir, "gens").select("event_id", rung.alias("rung"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'compliant' ELSE 'deviation' END WHEN event_type = 'click' THEN 'deviation' WHEN event_type = 'view' THEN 'compliant' ELSE 'unknown' END AS category FROM events""")
def fn_31_fips_category(spark, sf_dir):
    kind = F.when(C("event_type") == "error", "toolchain").when(C("event_type") == "click", "algorithm").when(C("event_type") == "view", "direct-random").otherwise("cgo")
    return t(spark, sf_dir, "events").select("event_id", classify.fips_category(kind, C("user_id") % 2 == 0).alias("category"))


@query(cte("licences") + """, a AS (SELECT id, expression AS x, target AS y FROM licences WHERE expression <> target)
SELECT id, x, y, x IN ('MIT') AND y IN ('GPL-3.0-only', 'AGPL-3.0-only') OR x = 'Apache-2.0' AND y IN ('GPL-3.0-only', 'AGPL-3.0-only') AS escalation FROM a""")
def set_05_licence_diff(spark, sf_dir):
    l = carrier(spark, sf_dir, "licences")
    d = diff.snapshot_diff(l.select("id", C("expression").alias("spdx")), l.select("id", C("target").alias("spdx")), ["id"], ["spdx"])
    return d.select("id", C("a_spdx").alias("x"), C("b_spdx").alias("y"), licence.escalation(C("a_spdx"), C("b_spdx")).alias("escalation"))


@query(cte("gens") + """, s AS (SELECT module, event_id FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY taken DESC, event_id) AS n FROM gens) WHERE n = 1)
SELECT g.event_id, CASE WHEN s.event_id IS NULL THEN 'not served' ELSE 'wrong finding' END AS reason FROM gens g LEFT JOIN s ON s.event_id = g.event_id WHERE g.findings = 'Affected' AND (s.event_id IS NULL OR g.coverage <> 'Analysed')""")
def set_11_index_check(spark, sf_dir):
    g = carrier(spark, sf_dir, "gens")
    served = compose.served(g, ["module"], [C("taken").desc(), C("event_id").asc()]).select("event_id", F.lit(True).alias("s"))
    x = g.where("findings = 'Affected'").join(served, "event_id", "left").where(C("s").isNull() | (C("coverage") != "Analysed"))
    return x.select("event_id", F.when(C("s").isNull(), "not served").otherwise("wrong finding").alias("reason"))


@query(cte("gens") + """, r AS (SELECT *, source IN ('view', 'click') AS d, max(source IN ('view', 'click')) OVER (PARTITION BY module) AS any_d, max(source = 'signup') OVER (PARTITION BY module) AS unknown FROM gens),
k AS (SELECT *, CASE findings WHEN 'Clean' THEN 2 WHEN 'Withdrawn' THEN 1 ELSE 0 END AS anchor FROM r WHERE d = any_d)
SELECT module, event_id, unknown FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY anchor DESC, taken DESC, event_id) AS n FROM k) WHERE n = 1""")
def cmp_11_stdlib_facts(spark, sf_dir):
    g = carrier(spark, sf_dir, "gens").withColumn("unknown", F.max(C("source") == "signup").over(Window.partitionBy("module")))
    g = compose.preferred_group(g, ["module"], C("source").isin("view", "click"))
    anchor = F.when(C("findings") == "Clean", 2).when(C("findings") == "Withdrawn", 1).otherwise(0)
    return compose.served(g, ["module"], [anchor.desc(), C("taken").desc(), C("event_id").asc()]).select("module", "event_id", "unknown")


@query("""WITH w AS (SELECT o_orderkey AS walk, o_custkey AS target, o_orderdate AS taken FROM orders), l AS (SELECT * FROM w x WHERE taken = (SELECT max(taken) FROM w y WHERE y.target = x.target))
SELECT walk, target, (SELECT count(*) FROM lineitem WHERE l_orderkey = walk) AS nodes FROM l""")
def cmd_08_walk_list_latest(spark, sf_dir):
    w = compose.latest_with_ties(t(spark, sf_dir, "orders").select(C("o_orderkey").alias("walk"), C("o_custkey").alias("target"), C("o_orderdate").alias("taken")), ["target"], "taken")
    n = t(spark, sf_dir, "lineitem").groupBy(C("l_orderkey").alias("walk")).agg(F.count("*").alias("nodes"))
    return w.join(n, "walk", "left").select("walk", "target", F.coalesce("nodes", F.lit(0)).alias("nodes"))


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE p_name LIKE '%bolt' ORDER BY p_name, p_partkey LIMIT 25 OFFSET 5""")
def cmd_09_symbol_find(spark, sf_dir):
    return rollup.page(t(spark, sf_dir, "part").where(C("p_name").endswith("bolt")).select("p_partkey", "p_name", "p_brand"), [C("p_name"), C("p_partkey")], 25, 5)


@query(cte("deps") + """, n AS (SELECT 'n' || CAST(n_nationkey AS STRING) AS node FROM nation UNION SELECT 's' || CAST(s_suppkey AS STRING) FROM supplier), i AS (SELECT dst AS node, count(DISTINCT src) AS callers FROM deps GROUP BY dst)
SELECT n.node, coalesce(callers, 0) AS callers, CASE WHEN callers > 0 THEN 'found' WHEN n.node LIKE '%7' THEN 'UNRESOLVED' ELSE 'RESOLVED-ABSENT' END AS verdict FROM n LEFT JOIN i ON i.node = n.node""")
def cmd_03_callers_with_verdict(spark, sf_dir):
    no, yes = F.lit(False), F.lit(True)
    n = t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), C("n_nationkey").cast("string")).alias("node")).union(t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), C("s_suppkey").cast("string"))))
    i = carrier(spark, sf_dir, "deps").groupBy(C("dst").alias("node")).agg(F.countDistinct("src").alias("callers"))
    s = classify.sinks(C("node"), C("node").endswith("7"), no, no, no, yes, yes, no)
    x = n.join(i, "node", "left")
    return x.select("node", F.coalesce("callers", F.lit(0)).alias("callers"), F.when(C("callers") > 0, "found").otherwise(classify.negative_verdict(s)).alias("verdict"))


@query(cte("licences") + """ SELECT id, CASE target WHEN 'MIT' THEN ['notice', 'text'] WHEN 'Apache-2.0' THEN ['changes', 'marks', 'notice', 'patent', 'text'] WHEN 'GPL-3.0-only' THEN ['changes', 'notice', 'patent', 'source', 'text'] ELSE ['changes', 'network', 'notice', 'patent', 'source', 'text'] END AS must, expression IN ('MIT', 'Apache-2.0', 'GPL-2.0', 'GPL-2.0-or-later', 'MPL-2.0', 'AGPL-3.0-only', 'CC-BY-4.0') AS known FROM licences""")
def fn_26_obligations(spark, sf_dir):
    l = carrier(spark, sf_dir, "licences")
    return l.select("id", licence.obligations(C("target")).alias("must"), licence.obligations(C("expression")).isNotNull().alias("known"))


@query("""WITH h AS (SELECT 'host/own/mod' || CAST(c_nationkey AS STRING) AS path, CASE WHEN c_custkey % 3 = 0 THEN 'The ' || n_name || ' Team' ELSE 'Somebody' END AS holder, 'host/' || lower(n_name) || '/mod' || CAST(c_nationkey AS STRING) AS other FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT path FROM (SELECT DISTINCT path, holder FROM h) GROUP BY path HAVING count(*) > 1)
SELECT path, 'multiple_holders' AS signal, NULL AS canonical FROM m UNION ALL SELECT DISTINCT path, 'holder_matches_path', other FROM h WHERE holder <> 'Somebody' AND regexp_matches(lower(holder), '[a-z0-9]{5,}')
AND len(list_filter(string_split_regex(lower(holder), '[^a-z0-9]+'), lambda w: length(w) >= 5 AND (contains(string_split(other, '/')[2], w) OR contains(w, string_split(other, '/')[2]) OR contains(string_split(other, '/')[3], w) OR contains(w, string_split(other, '/')[3])))) > 0""")
def fn_43_republications(spark, sf_dir):
    x = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), C("c_nationkey") == C("n_nationkey"))
    n = C("c_nationkey").cast("string")
    x = x.select(F.concat(F.lit("host/own/mod"), n).alias("path"), F.when(C("c_custkey") % 3 == 0, F.concat(F.lit("The "), "n_name", F.lit(" Team"))).otherwise("Somebody").alias("holder"), F.concat(F.lit("host/"), F.lower("n_name"), F.lit("/mod"), n).alias("other"))
    return joins.republications(x, x, x.select("path", "other", F.lit(False).alias("by_replace")))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0 OR MIT' ELSE '' END AS spdx FROM part""")
def x_03_spdx_header(spark, sf_dir):
    s = C("p_size") % 3
    src = F.when(s == 0, "package p\n// SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: ISC").when(s == 1, "/* SPDX-License-Identifier: Apache-2.0 OR MIT */\nint x;").otherwise("package p")
    return t(spark, sf_dir, "part").select("p_partkey", text.spdx_header(src).alias("spdx"))


@query("""SELECT o_orderkey AS walk, 'sha256:' || sha256('{"target":"c' || CAST(o_custkey AS STRING) || '","scope":"' || o_orderstatus || '","depth":""}') AS identity FROM orders""")
def x_12_walk_identity(spark, sf_dir):
    row = F.struct(F.concat(F.lit("c"), C("o_custkey").cast("string")).alias("target"), C("o_orderstatus").alias("scope"), F.lit("").alias("depth"))
    return t(spark, sf_dir, "orders").select(C("o_orderkey").alias("walk"), text.canonical_hash(row).alias("identity"))
