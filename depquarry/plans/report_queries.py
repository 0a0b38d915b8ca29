"""Queries of the governance, provenance and ledger reports, of paths from predecessors, and of functions that had no row of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from depquarry.functions import classify, licence, text
from depquarry.operators import governance, graph, provenance
from depquarry.operators.rollup import fault_bounds
from depquarry.plans.carriers import carrier, cte
from depquarry.plans.queries import query, t
from depquarry.sources import ledger

C = F.col


def s(c):
    return C(c).cast("string")


# ---- governance ----------------------------------------------------------------------------------------

POLICIES = {
    "directive": {"local_path_replace": "warn", "module_path_replace": "notify", "default": "notify"},
    "godebug": {"red": "warn", "amber": "notify"},
    "vendor": {"drift": "warn"},
    "fips": {"required": "yes", "deviation": "notify"},
}

FOUND = """f AS (
  SELECT o_custkey AS project, 'directive' AS area, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'warn' WHEN o_orderpriority = '2-HIGH' THEN 'notify' ELSE 'notify' END ELSE 'notify' END AS outcome FROM orders
  UNION ALL SELECT user_id, 'godebug', CASE event_type WHEN 'error' THEN 'warn' WHEN 'view' THEN 'notify' WHEN 'click' THEN 'allow' ELSE 'warn' END FROM events
  UNION ALL SELECT l_suppkey, 'vendor', CASE l_returnflag WHEN 'A' THEN 'warn' ELSE 'allow' END FROM lineitem
  UNION ALL SELECT s_suppkey, 'fips', CASE WHEN s_acctbal < 0 THEN 'notify' WHEN s_suppkey % 2 = 0 THEN 'allow' ELSE 'warn' END FROM supplier)"""


def _governed(spark, sf_dir):
    p = C("o_orderpriority")
    kind = F.when(C("o_orderstatus") == "F", "replace").when(C("o_orderstatus") == "O", "exclude").otherwise("retract")
    new = F.when(p == "2-HIGH", "x/fork").when(p == "3-MEDIUM", "x/m").otherwise("")
    old = F.concat(F.lit("v1."), (C("o_orderkey") % 9).cast("string"), F.lit(".0"))
    category = governance.directive_category(kind, p == "1-URGENT", new, F.lit("x/m"), old, F.lit("v1.4.0"))
    directives = t(spark, sf_dir, "orders").select(C("o_custkey").alias("project"), F.lit("directive").alias("area"), category.alias("category"))
    setting = F.when(C("event_type") == "error", "tlsrsakex").when(C("event_type") == "view", "panicnil").when(C("event_type") == "click", "gocachetest").otherwise("nosuch")
    settings = t(spark, sf_dir, "events").select(C("user_id").alias("project"), F.lit("godebug").alias("area"), classify.godebug_tier(setting).alias("category"))
    vendored = t(spark, sf_dir, "lineitem").select(C("l_suppkey").alias("project"), F.lit("vendor").alias("area"), classify.vendor_category(F.when(C("l_returnflag") == "A", "drift").when(C("l_returnflag") == "R", "missing").otherwise("unverified")).alias("category"))
    fips = F.when(C("s_acctbal") < 0, "algorithm").when(C("s_suppkey") % 2 == 0, "direct-random").otherwise("cgo-crypto")
    crypto = t(spark, sf_dir, "supplier").select(C("s_suppkey").alias("project"), F.lit("fips").alias("area"), classify.fips_category(fips, F.lit(True)).alias("category"))
    return directives.unionByName(settings).unionByName(vendored).unionByName(crypto)


@query(f"WITH {FOUND} SELECT project, area, outcome, outcome = 'warn' AS blocking, count(*) AS n FROM f GROUP BY ALL")
def cmd_18_policy_outcomes(spark, sf_dir):
    """Findings of four areas held against a policy: counts by project, area and outcome."""
    j = governance.judged(_governed(spark, sf_dir), POLICIES)
    return j.groupBy("project", "area", "outcome", "blocking").agg(F.count("*").alias("n"))


@query(f"""WITH {FOUND}, m AS (SELECT c_custkey AS project, unnest(['directive', 'godebug', 'vendor', 'fips']) AS area FROM customer),
k AS (SELECT c.project, c.area, c.project % 3 <> length(c.area) % 3 AS measured, count(f.project) AS n, count(*) FILTER (f.outcome = 'notify') AS notify, count(*) FILTER (f.outcome = 'warn') AS blocking FROM m c LEFT JOIN f ON f.project = c.project AND f.area = c.area GROUP BY ALL),
w AS (SELECT *, CASE WHEN n > 0 THEN 'findings' WHEN measured THEN 'clean' ELSE 'not_measured' END AS status FROM k)
SELECT project, max(status) FILTER (area = 'directive') AS directive, max(status) FILTER (area = 'godebug') AS godebug, max(status) FILTER (area = 'vendor') AS vendor, max(status) FILTER (area = 'fips') AS fips, CAST(sum(notify) AS BIGINT) AS notify, CAST(sum(blocking) AS BIGINT) AS blocking,
CASE WHEN sum(blocking) > 0 THEN false WHEN bool_and(status <> 'not_measured') THEN true END AS passes FROM w GROUP BY project""")
def cmd_18_governance(spark, sf_dir):
    """The gate of every customer as a project: what was measured, what was found, what blocks."""
    projects = t(spark, sf_dir, "customer").select(C("c_custkey").alias("project"))
    areas = projects.select("project", F.explode(F.array(*[F.lit(a) for a in governance.AREAS])).alias("area"))
    r = governance.report(projects, areas.where(C("project") % 3 != F.length("area") % 3), _governed(spark, sf_dir), ["project"], POLICIES)
    notify = sum((C(f"{a}.notify") for a in governance.AREAS), F.lit(0)).cast("long")
    return r.select("project", *[C(f"{a}.status").alias(a) for a in governance.AREAS], notify.alias("notify"), "blocking", "passes")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'x/m' WHEN 1 THEN 'x/fork' END AS path, CASE p_size % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v' || p_size END AS version, CASE p_size % 4 WHEN 0 THEN 'drift' ELSE 'inconsistency' END AS category FROM part""")
def fn_42_attested_coordinates(spark, sf_dir):
    k = C("p_size") % 3
    a = classify.attested(F.lit("x/m"), F.lit("v1"), F.when(k == 1, "x/fork").when(k == 2, "../fork").otherwise(""), F.when(k == 1, F.concat(F.lit("v"), s("p_size"))))
    kind = F.when(C("p_size") % 4 == 0, "drift").when(C("p_size") % 4 == 1, "missing").otherwise("extra")
    return t(spark, sf_dir, "part").select("p_partkey", a["path"].alias("path"), a["version"].alias("version"), classify.vendor_category(kind).alias("category"))


# ---- provenance ----------------------------------------------------------------------------------------

PROVENANCE = """rec AS (SELECT p_partkey AS line, 'host/owner' || (p_partkey % 7) || '/lib' || (p_partkey % 5) AS path, 'v1.' || p_size || '.0' AS version, p_size,
    CASE p_partkey % 4 WHEN 0 THEN 'Owner' || (p_size % 7) || ' Inc' WHEN 1 THEN '<name of author>' WHEN 2 THEN 'OWNER' || (p_size % 7) || ' inc' END AS holder FROM part),
  h AS (SELECT path, version, lower(holder) AS l, arg_min(holder, line) AS holder FROM rec WHERE holder LIKE 'O%' GROUP BY ALL),
  many AS (SELECT path, version, count(*) > 1 AS many FROM h GROUP BY ALL),
  rel AS (SELECT 'host/owner' || (l_partkey % 7) || '/lib' || (l_partkey % 5) AS path, 'host/owner' || (l_suppkey % 7) || CASE WHEN l_linenumber > 4 THEN '/go-lib' ELSE '/lib' END || (l_suppkey % 5) AS other, bool_or(l_returnflag = 'A' AND l_quantity > 49) AS by_replace FROM lineitem GROUP BY ALL),
  hit AS (SELECT h.path, h.version, count(DISTINCT other) AS matched FROM h JOIN rel ON rel.path = h.path AND rel.other <> h.path AND (by_replace OR contains(other, split_part(h.path, '/', 3))) AND split_part(other, '/', 2) = split_part(l, ' ', 1) GROUP BY ALL),
  st AS (SELECT r.path, r.version, r.p_size, bool_or(r.holder IS NOT NULL) AS stated, coalesce(bool_or(many), false) AS many, coalesce(max(matched), 0) AS matched FROM rec r LEFT JOIN many ON many.path = r.path AND many.version = r.version LEFT JOIN hit ON hit.path = r.path AND hit.version = r.version GROUP BY ALL),
  pv AS (SELECT *, CASE WHEN NOT stated THEN 'not_analysed' WHEN many OR matched > 0 THEN 'republication' ELSE 'none' END AS status FROM st)"""


def _provenance(spark, sf_dir):
    p, k = t(spark, sf_dir, "part"), C("p_partkey")
    path = lambda key, lib="/lib": F.concat(F.lit("host/owner"), (C(key) % 7).cast("string"), F.lit(lib) if isinstance(lib, str) else lib, (C(key) % 5).cast("string"))
    of = (C("p_size") % 7).cast("string")
    holder = F.when(k % 4 == 0, F.concat(F.lit("Owner"), of, F.lit(" Inc"))).when(k % 4 == 1, "<name of author>").when(k % 4 == 2, F.concat(F.lit("OWNER"), of, F.lit(" inc")))
    rec = p.select(path("p_partkey").alias("path"), F.concat(F.lit("v1."), s("p_size"), F.lit(".0")).alias("version"), k.alias("line"), holder.alias("holder"))
    lines = rec.withColumn("verbatim", F.concat(F.lit("Copyright "), C("holder")))
    l = t(spark, sf_dir, "lineitem")
    related = l.select(path("l_partkey").alias("path"), path("l_suppkey", F.when(C("l_linenumber") > 4, "/go-lib").otherwise("/lib")).alias("other"), ((C("l_returnflag") == "A") & (C("l_quantity") > 49)).alias("by_replace"))
    return rec, lines, related


@query(f"""WITH {PROVENANCE} SELECT path, version, 'newest' AS rule, n AS candidates, status, many AS many_holders, matched, kinds > 1 AS versions_disagree
FROM (SELECT *, count(*) OVER (PARTITION BY path) AS n, len(list(DISTINCT status) OVER (PARTITION BY path)) AS kinds, row_number() OVER (PARTITION BY path ORDER BY p_size DESC) AS r FROM pv) WHERE r = 1""")
def cmd_21_provenance(spark, sf_dir):
    """Parts as licence records of 35 modules, lines as what relates them."""
    return provenance.report(*_provenance(spark, sf_dir))


@query(f"""WITH {PROVENANCE} SELECT a.path, a.version, 'pinned' AS rule, CAST(NULL AS BIGINT) AS candidates, coalesce(status, 'not_analysed') AS status, coalesce(many, false) AS many_holders, coalesce(matched, 0) AS matched, false AS versions_disagree
FROM (SELECT DISTINCT 'host/owner' || (s_suppkey % 7) || '/lib' || (s_suppkey % 5) AS path, 'v1.' || (s_suppkey % 60) || '.0' AS version FROM supplier) a LEFT JOIN pv ON pv.path = a.path AND pv.version = a.version""")
def cmd_21_provenance_pinned(spark, sf_dir):
    k = C("s_suppkey")
    asked = t(spark, sf_dir, "supplier").select(F.concat(F.lit("host/owner"), (k % 7).cast("string"), F.lit("/lib"), (k % 5).cast("string")).alias("path"), F.concat(F.lit("v1."), (k % 60).cast("string"), F.lit(".0")).alias("version"))
    return provenance.report(*_provenance(spark, sf_dir), asked)


# ---- the ledger ----------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, event_id, event_type, value < 10 AS fault, user_id % 9 AS m, CASE WHEN value >= 10 THEN ts END AS ts FROM events),
b AS (SELECT *, last_value(ts IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after, first_value(ts IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS before FROM e),
g AS (SELECT user_id, min(ts) AS first_event, max(ts) AS last_event, count(*) FILTER (NOT fault) AS events, count(*) AS lines_read, count(*) FILTER (fault) AS unreadable,
  count(*) FILTER (fault AND NOT coalesce(after > TIMESTAMP '2024-01-11 00:00:00', false) AND NOT coalesce(before < TIMESTAMP '2024-01-10 00:00:00', false)) AS unreadable_in_window,
  count(*) FILTER (NOT fault AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-11 00:00:00') AS w, count(*) FILTER (NOT fault AND m = 4) AS p, count(*) FILTER (NOT fault AND event_type = 'error') AS t,
  count(*) FILTER (NOT fault AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-11 00:00:00' AND m = 4 AND event_type = 'error') AS matched FROM b GROUP BY user_id)
SELECT user_id, first_event, last_event, events, lines_read, unreadable, unreadable_in_window, matched, CASE WHEN matched > 0 OR events = 0 THEN '' WHEN w > 0 AND p > 0 AND t > 0 THEN 'together' ELSE concat_ws(',', CASE WHEN w = 0 THEN CASE WHEN TIMESTAMP '2024-01-11 00:00:00' < first_event OR TIMESTAMP '2024-01-10 00:00:00' > last_event THEN 'outside_coverage' ELSE 'empty_window' END END, CASE WHEN p = 0 THEN 'unknown_module' END, CASE WHEN t = 0 THEN 'unknown_event' END) END AS why FROM g""")
def cmd_20_ledger_report(spark, sf_dir):
    """Every user's events as a log of its own, asked for one module's errors of a day."""
    e = t(spark, sf_dir, "events")
    payload = F.create_map(F.lit("path"), F.concat(F.lit("m"), (C("user_id") % 9).cast("string")))
    lines = e.select("user_id", "event_id", C("event_type").alias("event"), (C("value") < 10).alias("fault"), payload.alias("payload"), F.when(C("value") >= 10, C("ts").cast("timestamp")).alias("ts"))
    bounded = fault_bounds(lines, "event_id", "ts", ["user_id"])
    r = ledger.report(bounded, ["user_id"], "2024-01-10 00:00:00", "2024-01-11 00:00:00", "error", "m4")
    return r.select("user_id", *[C(c).cast("timestamp_ntz").alias(c) for c in ("first_event", "last_event")], "events", "lines_read", "unreadable", "unreadable_in_window", "matched", F.array_join("zero_reasons", ",").alias("why"))


# ---- graphs --------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE up AS (SELECT p_partkey AS id, p_partkey AS here, CAST(p_partkey AS VARCHAR) AS way FROM part UNION ALL
SELECT up.id, q.pred, q.pred || '>' || up.way FROM up JOIN (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_partkey // 2 ELSE p_partkey * 3 // 4 END AS pred FROM part WHERE p_partkey > 1) q ON q.p_partkey = up.here WHERE q.pred >= 1)
SELECT id AS node, way FROM up WHERE here = 1""")
def grf_08_paths_back(spark, sf_dir):
    """Every part's way from part 1 over predecessors that halve its number, or take a quarter off it."""
    k = C("p_partkey")
    pred = F.when(k > 1, F.floor(F.when(C("p_size") % 2 == 0, k / 2).otherwise(k * 3 / 4)).cast("long"))
    parts = t(spark, sf_dir, "part").where(k >= 1).select(k.alias("node"), pred.alias("pred"))
    return graph.paths_back(parts, parts.select("node")).select("node", F.array_join(C("path").cast("array<string>"), ">").alias("way"))


@query("""WITH c AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS up FROM customer), n AS (SELECT up AS node, min(node) AS pred FROM c GROUP BY up)
SELECT node, NULL AS pred, 0 AS depth FROM c UNION ALL SELECT node, pred, 1 FROM n UNION ALL SELECT 'r' || n_regionkey, min(node), 2 FROM n JOIN nation ON 'n' || n_nationkey = node GROUP BY n_regionkey
UNION ALL SELECT 'n' || x.n_nationkey, 'r' || x.n_regionkey, 3 FROM nation x WHERE 'n' || x.n_nationkey NOT IN (SELECT node FROM n) AND x.n_regionkey IN (SELECT n_regionkey FROM n JOIN nation ON 'n' || n_nationkey = node)""")
def grf_08_predecessors(spark, sf_dir):
    """The levels above all customers, each node with the predecessor that a path back takes."""
    edges = carrier(spark, sf_dir, "deps").select("src", "dst")
    roots = t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), s("c_custkey")).alias("node"))
    return graph.predecessors(edges, graph.levels(edges, roots))


# ---- functions -----------------------------------------------------------------------------------------


@query(cte("gens") + """ SELECT event_id, CASE WHEN completeness <> 'BuiltWithBodies' THEN 'completeness level differs: before=' || completeness || ' after=BuiltWithBodies' WHEN source <> 'view' THEN 'algorithm/devirt tier differs: before=' || source || ' after=view' END AS parity,
CASE WHEN completeness = 'BuiltWithBodies' THEN '' ELSE 'call graph is ' || completeness || ', not built with bodies — generators are not run on untrusted code, so this verdict is degraded and may be incomplete' END AS caveat FROM gens""")
def fn_39_completeness(spark, sf_dir):
    level = C("completeness")
    parity = classify.completeness_parity(level, C("source"), F.lit("BuiltWithBodies"), F.lit("view"))
    return carrier(spark, sf_dir, "gens").select("event_id", parity.alias("parity"), classify.completeness_caveat(level, "inclusion").alias("caveat"))


@query("""SELECT doc_id, sha256(trim(regexp_replace(text, '^([ \\t]*//[^\\n]*(\\n|$))+', ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS bare FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '// a' || chr(10) || '  // b' || chr(10) WHEN 1 THEN chr(10) || '// kept' || chr(10) ELSE '/* c */ ' END || coalesce(text, '') AS text FROM documents)""")
def fn_14_bare_signatures(spark, sf_dir):
    k = C("doc_id") % 3
    said = F.concat(F.when(k == 0, "// a\n  // b\n").when(k == 1, "\n// kept\n").otherwise("/* c */ "), F.coalesce("text", F.lit("")))
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode(text.bare_signature(said), "UTF-8"), 256).alias("bare"))


@query(cte("licences") + """ SELECT id, CASE WHEN expression = 'GPL-2.0' THEN 'GPL-2.0-only' ELSE expression END AS canonical, CASE WHEN expression = 'BSD-3-Clause AND MIT' THEN 'BSD-3-Clause,MIT' END AS both, CASE WHEN expression NOT LIKE '% %' AND expression <> '' THEN expression END AS sole FROM licences""")
def fn_21_arms_and_aliases(spark, sf_dir):
    e = C("expression")
    return carrier(spark, sf_dir, "licences").select("id", licence.canonical(e).alias("canonical"), F.array_join(licence.arms(e, "AND"), ",").alias("both"), licence.sole_identifier(e).alias("sole"))
