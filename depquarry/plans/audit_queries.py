"""Queries of :mod:`depquarry.operators.audit` and of the catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from depquarry.functions import catalogues, classify, text
from depquarry.operators import audit, diff, rollup
from depquarry.plans.carriers import carrier, cte
from depquarry.plans.queries import query, t
from depquarry.sources import advisories, store

C = F.col


def _case(expression: str, table: dict[str, str]) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _picked(values) -> str:
    """SQL of the value at a row's key, from a list in SQL."""
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _of(values, n):
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


# ---- sources -------------------------------------------------------------------------------------------


@query("""SELECT n_name AS path, CAST(user_id AS STRING) || '-' || event_type AS id, CASE WHEN value > 50 THEN '1.' || CAST(event_id AS STRING) || '.0' ELSE '' END AS fixed FROM events JOIN nation ON user_id % 25 = n_nationkey""")
def src_12_index_decode(spark, sf_dir):
    """Each event is an advisory in the JSON list of its user's row."""
    item = F.struct(F.concat_ws("-", "user_id", "event_type").alias("id"), F.when(C("value") > 50, F.concat(F.lit("1."), C("event_id").cast("string"), F.lit(".0"))).alias("fixed"))
    e = t(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.collect_list(item)).alias("document"))
    n = t(spark, sf_dir, "nation").select(C("n_nationkey"), "n_name")
    return advisories.index_entries(e.join(n, C("user_id") % 25 == C("n_nationkey")), "n_name", "document")


# ---- narrowing -----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1999-12-31 00:00:00'""")
def flt_01_conjunctive(spark, sf_dir):
    x = audit.narrowed(t(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_custkey": None}, "o_orderdate", "1996-01-01", "1999-12-31")
    return x.select("o_orderkey", "o_custkey")


@query("SELECT event_id FROM events WHERE user_id = 8 AND ts >= TIMESTAMP '2024-01-02 00:00:00'")
def flt_05_extraction_runs(spark, sf_dir):
    return audit.narrowed(t(spark, sf_dir, "events"), {"user_id": 8, "event_type": None}, "ts", since="2024-01-02").select("event_id")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#3')""")
def flt_07_scope_members(spark, sf_dir):
    scope = t(spark, sf_dir, "part").where("p_brand = 'Brand#3'").select(C("p_partkey").alias("l_partkey"))
    return audit.members(t(spark, sf_dir, "lineitem"), scope, ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT s_suppkey, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50) AS known FROM supplier""")
def flt_09_exists(spark, sf_dir):
    hit = t(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(C("l_suppkey").alias("s_suppkey"))
    return store.existing_of(t(spark, sf_dir, "supplier").select("s_suppkey"), hit, ["s_suppkey"])


@query("""SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def flt_10_context_nodes(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    allow = c.join(t(spark, sf_dir, "nation").where("n_regionkey = 1"), C("c_nationkey") == C("n_nationkey")).select("c_custkey")
    affected = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(C("o_custkey").alias("c_custkey"))
    return audit.context_nodes(c, ["c_custkey"], C("c_acctbal") > 0, allow, affected).select("c_custkey")


@query("""SELECT p_brand AS package, list_sort(list(DISTINCT p_name)) AS names FROM part WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY p_brand""")
def flt_11_interface_projection(spark, sf_dir):
    return audit.projected_symbols(t(spark, sf_dir, "part"), "p_brand", "p_type", "p_name", ["ECONOMY", "PROMO"])


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def flt_15_exclusions(spark, sf_dir):
    out = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(C("c_custkey").alias("o_custkey"))
    return audit.beyond(t(spark, sf_dir, "orders"), out, ["o_custkey"]).select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O'""")
def flt_17_without_tests(spark, sf_dir):
    return audit.edges_asked(t(spark, sf_dir, "lineitem"), C("l_linestatus") == "F").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# ---- joins ---------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT l.l_orderkey, l.l_partkey, l.l_suppkey FROM lineitem l JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) f ON l.l_partkey = f.l_partkey AND l.l_suppkey = f.l_suppkey""")
def jon_01_records_with_findings(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")
    index = l.where("l_returnflag = 'R' AND l_quantity > 45")
    return audit.with_finding(l.select("l_orderkey", "l_partkey", "l_suppkey"), index, ["l_partkey", "l_suppkey"])


@query("""SELECT DISTINCT o_custkey AS walk, p_partkey AS module, p_brand AS record FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""")
def jon_02_four_way(spark, sf_dir):
    """Orders are runs, customers walks, parts modules: the records with findings of every walk's runs."""
    l = t(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("run"), C("l_partkey").alias("module"), "l_returnflag", "l_quantity")
    records = audit.with_finding(t(spark, sf_dir, "part").select(C("p_partkey").alias("module"), C("p_brand").alias("record")), l.where("l_returnflag = 'R' AND l_quantity > 45"), ["module"])
    runs = t(spark, sf_dir, "orders").select(C("o_orderkey").alias("run"), C("o_custkey").alias("walk"))
    return audit.of_walks(records, l, runs, ["module"], "run", "walk")


@query("""SELECT DISTINCT o_custkey AS walk, l_partkey AS module, p_brand AS record FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = 5""")
def jon_03_module_in_walks(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("run"), C("l_partkey").alias("module"))
    records = t(spark, sf_dir, "part").select(C("p_partkey").alias("module"), C("p_brand").alias("record"))
    return audit.of_walks(records, l, t(spark, sf_dir, "orders").select(C("o_orderkey").alias("run"), C("o_custkey").alias("walk")), ["module"], "run", "walk", 5)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 'sha-' || o_orderstatus AS record FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def jon_07_edges_inherit_hash(spark, sf_dir):
    r = t(spark, sf_dir, "orders").select(C("o_orderkey").alias("l_orderkey"), F.concat(F.lit("sha-"), "o_orderstatus").alias("record"))
    return audit.inherited(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), r, ["l_orderkey"], ["record"])


@query("""SELECT o_orderkey, c_name, n_name, r_name, c_acctbal, c_custkey IS NOT NULL AS customer_recorded, n_nationkey IS NOT NULL AS nation_recorded, r_regionkey IS NOT NULL AS region_recorded
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 3""")
def jon_14_audit_star(spark, sf_dir):
    """Some customers and regions have no record."""
    facts = {
        "customer": (t(spark, sf_dir, "customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"]),
        "nation": (t(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"]),
        "region": (t(spark, sf_dir, "region").where("r_regionkey <> 3").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"]),
    }
    return audit.audit_rows(t(spark, sf_dir, "orders"), facts).select("o_orderkey", "c_name", "n_name", "r_name", "c_acctbal", *[f"{f}_recorded" for f in facts])


@query("""SELECT p_partkey, min(s_name) AS doc, count(DISTINCT l_orderkey) AS examples FROM part LEFT JOIN supplier ON s_suppkey = p_partkey LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49 GROUP BY p_partkey""")
def jon_15_symbol_context(spark, sf_dir):
    docs = t(spark, sf_dir, "supplier").select(C("s_suppkey").alias("p_partkey"), C("s_name").alias("doc"))
    ex = t(spark, sf_dir, "lineitem").where("l_quantity > 49").withColumnRenamed("l_partkey", "p_partkey")
    return audit.symbol_context(t(spark, sf_dir, "part").select("p_partkey"), docs, ex, ["p_partkey"], "l_orderkey")


@query("""SELECT l_suppkey AS module, list_sort(list(DISTINCT l_partkey)) AS present FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 3) GROUP BY l_suppkey""")
def jon_20_symbols_in_binary(spark, sf_dir):
    table = t(spark, sf_dir, "part").where("p_size = 3").select(C("p_partkey").alias("l_partkey"))
    return audit.symbols_in_binary(t(spark, sf_dir, "lineitem"), table, "l_suppkey", "l_partkey")


# ---- build lists ---------------------------------------------------------------------------------------


@query(cte("mods") + """, n AS (SELECT path, version, size % 4 > 1 AS selected FROM mods UNION ALL SELECT path, 'v0.0.1', false FROM mods WHERE size % 6 = 0) SELECT path, version, bool_or(selected) AS selected FROM n GROUP BY path, version""")
def grf_12_known_and_selected(spark, sf_dir):
    m, was = carrier(spark, sf_dir, "mods"), C("size") % 6 == 0
    source = F.when(C("size") % 4 == 0, "stdlib").when(C("size") % 4 == 1, "local_replace").otherwise("proxy")
    return audit.versions_of_walk(m.select("path", "version", source.alias("source"), F.when(was, C("path")).alias("original_path"), F.when(was, "v0.0.1").alias("original_version")))


@query("""SELECT DISTINCT 'm' || CAST(l_partkey AS STRING) AS path, CAST(l_suppkey AS STRING) AS version FROM lineitem WHERE l_orderkey = 7""")
def grf_17_shallow_resolve(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("src_path"), F.lit("v1").alias("src_version"), F.concat(F.lit("m"), C("l_partkey").cast("string")).alias("path"), C("l_suppkey").cast("string").alias("version"))
    return audit.shallow_resolve(x, 7, "v1")


MODULES = """m AS (SELECT CAST(l_partkey AS STRING) AS path, 'v' || CAST(max(l_suppkey) AS STRING) AS version, l_partkey % 50 = 0 AS main, CASE WHEN l_partkey % 7 = 0 THEN 'fork/' || CAST(l_partkey AS STRING) WHEN l_partkey % 11 = 0 THEN '../local' END AS replace_path, CASE WHEN l_partkey % 7 = 0 THEN 'v9' END AS replace_version FROM {lineitem} WHERE l_partkey % 13 <> 0 GROUP BY l_partkey)"""
GRAPH = """g AS (SELECT CASE WHEN l_partkey % 17 = 0 THEN 'go' ELSE CAST(l_orderkey % 500 AS STRING) END AS src, CAST(l_partkey AS STRING) AS dst, 'v' || CAST(l_suppkey AS STRING) AS asked FROM {lineitem})"""


def _build_list(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")
    return (spark.sql(f"WITH {q} SELECT * FROM {q.split(' ')[0]}", lineitem=l) for q in (MODULES, GRAPH))


@query(f"""WITH {MODULES.format(lineitem='lineitem')}, {GRAPH.format(lineitem='lineitem')}, n AS (SELECT path AS own, coalesce(CASE WHEN replace_version IS NOT NULL THEN replace_path END, path) AS path, coalesce(replace_version, version) AS version FROM m)
SELECT coalesce(s.path, g.src) AS src_path, s.version AS src_version, coalesce(d.path, g.dst) AS dst_path, CASE WHEN d.path IS NULL THEN g.asked ELSE d.version END AS dst_version, min(g.asked) AS asked FROM g LEFT JOIN n s ON s.own = g.src LEFT JOIN n d ON d.own = g.dst WHERE g.src <> 'go' AND g.dst <> 'go' GROUP BY 1, 2, 3, 4""")
def grf_18_from_build_list(spark, sf_dir):
    return audit.from_build_list(*_build_list(spark, sf_dir))[1]


@query(f"""WITH {MODULES.format(lineitem='lineitem')} SELECT CASE WHEN replace_version IS NULL THEN path ELSE replace_path END AS path, coalesce(replace_version, version) AS version, CASE WHEN replace_path IS NOT NULL AND replace_version IS NULL THEN 'local_replace' ELSE 'proxy' END AS source FROM m WHERE NOT main""")
def grf_18_build_list_nodes(spark, sf_dir):
    return audit.from_build_list(*_build_list(spark, sf_dir))[0]


# ---- roll-ups ------------------------------------------------------------------------------------------


@query("""SELECT o_custkey AS module, count(*) AS generations, max(o_orderdate) AS newest, count(*) > 1 AS composed FROM orders GROUP BY o_custkey""")
def agg_06_newest_first_groups(spark, sf_dir):
    return audit.generation_groups(t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "module"), ["module"], "o_orderdate")


@query("""SELECT user_id, min(value) AS lo, max(value) AS hi, count(value) AS n, max(event_id) AS last FROM events GROUP BY user_id""")
def agg_12_measurements(spark, sf_dir):
    return audit.measurements(t(spark, sf_dir, "events"), ["user_id"], "value", "event_id")


@query(cte("licences") + " SELECT id FROM licences WHERE expression = ''")
def agg_14_undetermined(spark, sf_dir):
    return audit.undetermined(carrier(spark, sf_dir, "licences"), "expression").select("id")


@query("""SELECT l_partkey AS coordinate, l_returnflag AS spdx, list_sort(list(DISTINCT 'f' || CAST(l_suppkey AS STRING))) AS paths, count(DISTINCT l_linestatus) > 1 AS conflict FROM lineitem GROUP BY l_partkey, l_returnflag""")
def agg_15_snippet_paths(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").select(C("l_partkey").alias("coordinate"), C("l_returnflag").alias("spdx"), F.concat(F.lit("f"), C("l_suppkey").cast("string")).alias("path"), "l_linestatus")
    return audit.snippet_paths(l, ["coordinate", "spdx"], "path", "l_linestatus")


@query("""SELECT user_id AS build, count(*) AS queried, count(*) FILTER (WHERE value > 50) AS covered, count(*) FILTER (WHERE event_type = 'error') AS with_findings, coalesce(list_sort(list(DISTINCT event_type) FILTER (WHERE value <= 50)), []) AS uncovered FROM events GROUP BY user_id""")
def agg_16_probe_counters(spark, sf_dir):
    return audit.probe_counters(t(spark, sf_dir, "events").withColumnRenamed("user_id", "build"), ["build"], C("value") > 50, C("event_type") == "error", C("event_type"))


@query("""SELECT user_id AS project, CASE WHEN bool_or(event_type = 'error' AND value > 100) THEN 'findings' ELSE 'clean' END AS status, list_sort(list(DISTINCT event_type)) AS packages FROM events GROUP BY user_id""")
def agg_17_governance_status(spark, sf_dir):
    return audit.governance_status(t(spark, sf_dir, "events").withColumnRenamed("user_id", "project"), ["project"], "event_type", (C("event_type") == "error") & (C("value") > 100))


TOOLCHAINS = ("go1.22.1 X:boringcrypto", "go1.24.2", "go1.22", "rh-fips-1.21", "", "go1.25")
GO_VERSIONS = ("1.22.1", "1.24.2", "1.22", "", "junk", "1.25")
SETTINGS = ("on", "on", "", "off", "only", "off", "")


@query(f"""WITH p AS (SELECT c_custkey AS project, {_picked(TOOLCHAINS)}[CAST(c_custkey % 6 AS INTEGER) + 1] AS toolchain, {_picked(GO_VERSIONS)}[CAST(c_custkey % 6 AS INTEGER) + 1] AS go, {_picked(SETTINGS)}[CAST(c_custkey % 7 AS INTEGER) + 1] AS mode FROM customer),
f AS (SELECT o_custkey AS project, list_sort(list(DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'crypto/md5' ELSE 'crypto/rc4' END) FILTER (WHERE o_orderstatus = 'P')) AS pk, list_sort(list(DISTINCT 'm' || CAST(o_orderkey % 3 AS STRING)) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH')) AS md FROM orders GROUP BY o_custkey),
v AS (SELECT *, CASE WHEN contains(toolchain, 'boring') THEN 'boringcrypto' WHEN contains(toolchain, 'rh-fips') THEN 'redhat-fips' WHEN mode IN ('on', 'only') AND go IN ('1.24.2', '1.25') THEN 'go-fips140' ELSE '' END AS variant FROM p)
SELECT v.project, variant, CASE WHEN variant = '' AND go IN ('1.24.2', '1.25') THEN 'not enabled: toolchain go' || go || ' ships native FIPS 140-3 but the fips140 directive ' || CASE WHEN mode = 'off' THEN 'is set to off' ELSE 'is not set' END || '; set //go:debug fips140=on (or GODEBUG=fips140=on) to enable'
WHEN variant = '' AND go IN ('1.22.1', '1.22') THEN 'not eligible: toolchain go' || go || ' predates native FIPS 140-3 (requires go1.24.0 or newer)' WHEN variant = '' THEN 'not eligible: toolchain does not provide native FIPS 140-3 and no FIPS-capable distribution was recognised'
WHEN len(pk) > 0 THEN 'not eligible: toolchain ' || variant || ' recognised but non-FIPS algorithm in use: ' || array_to_string(pk, ', ') WHEN len(md) > 0 THEN 'limited: toolchain ' || variant || ' recognised but cgo crypto dependency(ies) ' || array_to_string(md, ', ') || ' require separate cgo analysis'
ELSE 'eligible: toolchain ' || variant || ' recognised, no non-FIPS algorithm imports detected' END AS assessment FROM v LEFT JOIN f ON f.project = v.project""")
def agg_18_fips_assessment(spark, sf_dir):
    """Customers are projects, each with a toolchain; orders are findings."""
    k = C("c_custkey")
    p = t(spark, sf_dir, "customer").select(k.alias("project"), _of(TOOLCHAINS, k).alias("toolchain"), _of(GO_VERSIONS, k).alias("go_version"), _of(SETTINGS, k).alias("fips140"))
    kind = F.when(C("o_orderstatus") == "P", "algorithm").when((C("o_orderstatus") == "F") & (C("o_orderpriority") == "2-HIGH"), "cgo-crypto").otherwise("direct-random")
    package = F.when(C("o_orderpriority") == "1-URGENT", "crypto/md5").otherwise("crypto/rc4")
    f = t(spark, sf_dir, "orders").select(C("o_custkey").alias("project"), kind.alias("kind"), package.alias("package"), F.concat(F.lit("m"), (C("o_orderkey") % 3).cast("string")).alias("module"))
    return audit.fips_assessments(p, f, ["project"])


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 150) THEN 'cancelled' WHEN bool_or(event_type = 'error') THEN 'partial' ELSE 'succeeded' END AS status FROM events GROUP BY user_id""")
def agg_19_extraction_status(spark, sf_dir):
    err = C("event_type") == "error"
    return audit.extraction_status(t(spark, sf_dir, "events"), ["user_id"], err & (C("value") > 150), err)


# ---- sets ----------------------------------------------------------------------------------------------


@query(cte("snap_a", "snap_b") + """ SELECT coalesce(a.k, b.k) || '|' || coalesce(a.status, b.status) AS identity, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'reclassified' END AS change, a.priority AS before, b.priority AS after
FROM (SELECT CAST(k AS STRING) AS k, status, priority FROM snap_a) a FULL OUTER JOIN (SELECT CAST(k AS STRING) AS k, status, priority FROM snap_b) b ON a.k = b.k AND a.status = b.status WHERE a.priority IS DISTINCT FROM b.priority""")
def set_06_directive_diff(spark, sf_dir):
    return diff.directive_diff(carrier(spark, sf_dir, "snap_a"), carrier(spark, sf_dir, "snap_b"), ["k", "status"], "priority")


@query("""SELECT l_partkey AS k, coalesce(list_sort(list(DISTINCT l_suppkey) FILTER (WHERE l_returnflag IN ('A', 'N'))), []) AS merged FROM lineitem GROUP BY l_partkey""")
def set_08_merged_lists(spark, sf_dir):
    of = lambda f: F.collect_set(F.when(C("l_returnflag") == f, C("l_suppkey"))).alias(f)
    return t(spark, sf_dir, "lineitem").groupBy(C("l_partkey").alias("k")).agg(of("A"), of("N")).select("k", diff.merged(C("A"), C("N")).alias("merged"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def set_10_uncovered(spark, sf_dir):
    return audit.beyond(t(spark, sf_dir, "customer").select("c_custkey"), t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("""SELECT DISTINCT l_orderkey AS walk FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")
def set_12_unresolved_walks(spark, sf_dir):
    held = t(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(C("o_orderkey").alias("walk"))
    return audit.beyond(t(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("walk")), held, ["walk"]).distinct()


# ---- order ---------------------------------------------------------------------------------------------


@query(cte("deps") + """ SELECT src, dst, confidence, row_number() OVER (ORDER BY src, dst, confidence) AS place FROM deps""")
def srt_01_total_edge_order(spark, sf_dir):
    return rollup.placed(carrier(spark, sf_dir, "deps"), ["src", "dst", "confidence"])


NODES = """SELECT 'n' || CAST(p_partkey % 700 AS STRING) AS id, p_brand AS module, p_type AS package, p_name AS symbol, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'T' END AS receiver, 'f.go' AS file, p_size AS line, p_size % 3 = 0 AS is_external, p_size % 5 = 0 AS is_exported, p_size % 7 = 0 AS uses_unsafe, false AS is_assembly, false AS uses_plugin, p_size % 11 = 0 AS is_test FROM {part}"""
EDGES = """SELECT 'n' || CAST(l_orderkey % 900 AS STRING) AS from_id, 'n' || CAST(l_partkey % 300 AS STRING) AS to_id, 'f' || CAST(l_suppkey % 3 AS STRING) AS file, l_linenumber AS line, l_linestatus AS kind, l_returnflag AS confidence, l_quantity > 25 AS reflect FROM {lineitem}"""
INTERFACES = """SELECT 'i' || CAST(p_partkey % 90 AS STRING) AS id, p_brand AS package, p_type AS name, 'f.go' AS file, p_size % 4 AS line, p_size % 11 = 0 AS is_test, split(p_name, ' ') AS methods FROM {part}"""
REFS = """SELECT p_brand AS module_path, 'v' || CAST(p_size AS STRING) AS module_version, p_name AS package_path, p_type AS symbol_kind, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'T' END AS parent_type FROM {part}"""


def _ordered(rows: str, order: list[str]) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {', '.join(order)}) AS place FROM ({rows.format(part='part', lineitem='lineitem')})"


def _rows(spark, sf_dir, rows: str):
    return spark.sql(rows, **{n: t(spark, sf_dir, n) for n in ("part", "lineitem") if f"{{{n}}}" in rows})


@query(_ordered(NODES, rollup.CALL_NODE_ORDER))
def srt_02_call_nodes(spark, sf_dir):
    return rollup.placed(_rows(spark, sf_dir, NODES), rollup.CALL_NODE_ORDER)


@query(_ordered(EDGES, rollup.CALL_EDGE_ORDER))
def srt_02_call_edges(spark, sf_dir):
    return rollup.placed(_rows(spark, sf_dir, EDGES), rollup.CALL_EDGE_ORDER)


@query(_ordered(INTERFACES, rollup.INTERFACE_ORDER))
def srt_02_interfaces(spark, sf_dir):
    return rollup.placed(_rows(spark, sf_dir, INTERFACES), rollup.INTERFACE_ORDER)


@query("""WITH m AS (SELECT o_custkey % 200 AS type, o_orderpriority AS interface, list(DISTINCT o_orderstatus) AS l FROM orders GROUP BY 1, 2), i AS (SELECT interface AS interface_id, 't' || CAST(type AS STRING) AS type_id, 'p' AS package, 'f.go' AS file, type % 3 AS line, type % 2 = 0 AS is_test, list_sort(l) AS methods FROM m)
SELECT interface_id, type_id, line, is_test, array_to_string(methods, ',') AS methods, row_number() OVER (ORDER BY interface_id, type_id, package, file, line, is_test, len(methods), methods) AS place FROM i""")
def srt_02_implementations(spark, sf_dir):
    kind = C("o_custkey") % 200
    m = t(spark, sf_dir, "orders").groupBy(kind.alias("type"), C("o_orderpriority").alias("interface_id")).agg(F.array_sort(F.collect_set(F.struct(C("o_orderstatus").alias("method"), F.lit("n").alias("node_id")))).alias("methods"))
    i = m.select("interface_id", F.concat(F.lit("t"), C("type").cast("string")).alias("type_id"), F.lit("p").alias("package"), F.lit("f.go").alias("file"), (C("type") % 3).alias("line"), (C("type") % 2 == 0).alias("is_test"), "methods")
    return rollup.implementations_placed(i).select("interface_id", "type_id", "line", "is_test", F.array_join("methods.method", ",").alias("methods"), "place")


@query(_ordered(REFS, rollup.SYMBOL_REF_ORDER))
def srt_11_symbol_refs(spark, sf_dir):
    return rollup.placed(_rows(spark, sf_dir, REFS), rollup.SYMBOL_REF_ORDER)


# ---- functions -----------------------------------------------------------------------------------------

KNOBS = (*catalogues.GODEBUG_TIERS, "nosuch", "")


@query(f"""SELECT p_partkey, coalesce({_case('s', catalogues.GODEBUG_TIERS)}, 'unknown') AS tier FROM (SELECT p_partkey, {_picked(KNOBS)}[CAST(p_partkey % {len(KNOBS)} AS INTEGER) + 1] AS s FROM part)""")
def fn_30_godebug_tier(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", classify.godebug_tier(_of(KNOBS, C("p_partkey"))).alias("tier"))


SYMBOLS = (*catalogues.FUNCTION_CAPABILITIES, *[f"{p}.Other" for p in catalogues.PACKAGE_CAPABILITIES], "fmt.Println", "example.com/m.F")


@query(f"""SELECT p_partkey, list_distinct(list_filter([coalesce({_case('s', catalogues.FUNCTION_CAPABILITIES)}, {_case("regexp_extract(s, '^(.*?[^/.]*)[.][^/]*$', 1)", catalogues.PACKAGE_CAPABILITIES)}), CASE WHEN p_size % 5 = 0 THEN 'UNSAFE_POINTER' END, CASE WHEN p_size % 7 = 0 THEN 'ARBITRARY_EXECUTION' END], lambda x: x IS NOT NULL)) AS n
FROM (SELECT p_partkey, p_size, {_picked(SYMBOLS)}[CAST(p_partkey % {len(SYMBOLS)} AS INTEGER) + 1] AS s FROM part)""".replace("list_distinct(", "list_sort(list_distinct(").replace(")) AS n", "))) AS capabilities"))
def fn_32_capability_sinks(spark, sf_dir):
    s = _of(SYMBOLS, C("p_partkey"))
    package = F.regexp_extract(s, r"^(.*?[^/.]*)\.[^/]*$", 1)
    rest = F.split(F.expr("substring(s, length(package) + 2)"), r"\.")
    x = t(spark, sf_dir, "part").withColumn("s", s).withColumn("package", package).withColumn("rest", rest)
    receiver = F.when(F.size("rest") == 2, F.concat(F.lit("*"), F.get("rest", 0)))
    found = classify.node_capabilities(C("package"), receiver, F.element_at("rest", -1), C("p_size") % 5 == 0, C("p_size") % 7 == 0)
    return x.select("p_partkey", F.array_sort(found).alias("capabilities"))


MESSAGES = {
    "go: cannot load module ../x listed in go.work file: open: No such file or directory": "go-work-monorepo",
    "-mod may only be set to readonly when in workspace mode": "workspace-mode",
    "replacement directory ../x does not exist": "relative-replace-directive",
    "build constraints exclude all Go files in x/windows": "windows-only",
    "build constraints exclude all Go files in x": "build-incompatible",
    "fatal error: zlib.h: No such file or directory": "c-headers-missing",
    "missing go.sum entry for module": "missing-go-sum",
    "x.go:1:2: undefined: assets.ReadFile": "generated-assets-missing",
    "x.go:1:2: undefined: moduledata": "package-declarations-missing",
    "anything else": "build-incompatible",
}


@query(f"""SELECT p_partkey, {_case('m', MESSAGES)} AS reason FROM (SELECT p_partkey, {_picked((*MESSAGES, ''))}[CAST(p_partkey % {len(MESSAGES) + 1} AS INTEGER) + 1] AS m FROM part)""")
def fn_34_scan_failure(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", classify.scan_failure(_of((*MESSAGES, ""), C("p_partkey"))).alias("reason"))


@query(cte("mods") + """, k AS (SELECT DISTINCT path, version FROM mods WHERE size > 20), f AS (SELECT id, size, path, version FROM mods)
SELECT id, CASE WHEN size % 3 = 0 THEN 'version-not-in-toolchain-unverified' WHEN f.version = 'latest' THEN 'version-not-in-toolchain-unverified' WHEN k.path IS NULL THEN 'version-not-in-toolchain' ELSE 'incomplete-scan-cache' END AS reason,
CASE WHEN size % 3 <> 0 AND f.version <> 'latest' THEN f.path END AS path, CASE WHEN size % 3 <> 0 AND f.version <> 'latest' THEN f.version END AS version FROM f LEFT JOIN k ON k.path = f.path AND k.version = f.version""")
def fn_34_offline_failures(spark, sf_dir):
    """Refused lookups that name a module after others, or a position in a file of it."""
    m = carrier(spark, sf_dir, "mods")
    named = F.concat(F.lit("loading packages\nx@v1.0.0 requires "), "path", F.lit("@"), "version", F.lit(": Module lookup disabled by GOPROXY=off"))
    at = F.concat(F.lit("/tmp/cache/"), "path", F.lit("@"), "version", F.lit("/f.go:3:4: module lookup disabled by GOPROXY=off"))
    failures = m.select("id", F.when(C("size") % 3 == 0, at).otherwise(named).alias("message"))
    return audit.offline_failures(failures, m.where("size > 20").select("path", "version"), "message").select("id", "reason", "path", "version")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at_text, epoch_us(date_trunc('second', ts)) AS back FROM events")
def fn_45_rfc3339(spark, sf_dir):
    at = text.rfc3339(C("ts"))
    return t(spark, sf_dir, "events").select("event_id", at.alias("at_text"), F.unix_micros(text.from_rfc3339(at)).alias("back"))


@query("""SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL""")
def fn_47_json_fields(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy(text.json_field(C("props"), "$.k", "int").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT c_nationkey AS n_nationkey, list_sort(list(DISTINCT substr(c_mktsegment, 1, 3))) AS symbols FROM customer GROUP BY c_nationkey""")
def fn_49_flattened_symbols(spark, sf_dir):
    x = t(spark, sf_dir, "customer").groupBy(C("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.collect_list(F.substring("c_mktsegment", 1, 3)).alias("symbols"))
    return audit.flattened(x, ["n_nationkey"], "symbols")


# ---- commands ------------------------------------------------------------------------------------------


@query("""SELECT o_custkey AS module, count(*) AS records, CAST(sum(length('{"o_orderkey":' || CAST(o_orderkey AS STRING) || ',"o_orderstatus":"' || o_orderstatus || '"}')) AS BIGINT) AS bytes FROM orders GROUP BY o_custkey""")
def x_16_context_size(spark, sf_dir):
    return audit.context_size(t(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey", "o_orderstatus"])


@query(cte("licences") + """ SELECT expression, count(*) AS modules FROM licences WHERE contains(lower(expression), 'gpl') GROUP BY expression""")
def cmd_07_licence_list(spark, sf_dir):
    return audit.named_like(carrier(spark, sf_dir, "licences"), "expression", "GPL").groupBy("expression").agg(F.count("*").alias("modules"))


@query("""SELECT p_brand AS module, p_name AS symbol, count(*) AS examples FROM part WHERE contains(lower(p_name), 'widget') GROUP BY p_brand, p_name""")
def cmd_10_examples_find(spark, sf_dir):
    return audit.named_like(t(spark, sf_dir, "part"), "p_name", "Widget").groupBy(C("p_brand").alias("module"), C("p_name").alias("symbol")).agg(F.count("*").alias("examples"))


@query("""SELECT o_orderkey AS walk, c_name AS target, coalesce(n, 0) AS modules, coalesce(q, 0) AS affected FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n, count(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R') AS q FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def cmd_12_walk_context(spark, sf_dir):
    walks = t(spark, sf_dir, "orders").select(C("o_orderkey").alias("walk"), C("o_custkey").alias("k"))
    targets = t(spark, sf_dir, "customer").select(C("c_custkey").alias("k"), C("c_name").alias("target"))
    modules = t(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("walk"), C("l_partkey").alias("module"), "l_returnflag")
    return audit.walk_context(walks, targets, modules, "walk", "k", "module", C("l_returnflag") == "R").drop("k")
