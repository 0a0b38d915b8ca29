"""Queries over the test tables, one or more for each operator, with DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depquarry.functions import classify, licence, semver, text
from depquarry.operators import compose, diff, graph, joins, rollup
from depquarry.plans import oracle as o
from depquarry.plans.carriers import carrier, cte
from depquarry.sources import ledger, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that a task sorts at most, on average, where it is dealt by :func:`spread`.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many partitions as its rows need, so that a task's sort doesn't grow with the table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-df.count() // TASK_ROWS)), *keys)


# ---- sources, sinks ---------------------------------------------------------------------------------

LEDGER = """SELECT event_id AS line, user_id, CASE WHEN value < 10 THEN '{broken ' || props ELSE '{"event": "' || event_type || '", "ts": "2024-01-02 00:00:00", "path": "m' || CAST(user_id % 9 AS STRING) || '", "payload": ' || props || '}' END AS raw FROM {events}"""


def _ledger(spark, sf_dir):
    return spark.sql(LEDGER.replace("{broken ", "{{broken ").replace("'{\"event", "'{{\"event").replace("props || '}'", "props || '}}'"), events=t(spark, sf_dir, "events"))


@query(f"""WITH l AS ({LEDGER.replace('{events}', 'events')}), j AS (SELECT line, raw, CASE WHEN json_valid(raw) THEN raw END AS v FROM l)
SELECT line, json_extract_string(v, '$.event') AS event, CAST(json_extract_string(v, '$.payload.k') AS INTEGER) AS k, v IS NULL AS fault FROM j""")
def src_15_ledger_decode(spark, sf_dir):
    d = ledger.decoded(_ledger(spark, sf_dir))
    return d.select("line", "event", F.col("payload")["k"].cast("int").alias("k"), "fault")


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN value >= 10 THEN ts END AS taken FROM events)
SELECT event_id, last_value(taken IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after,
  first_value(taken IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS before FROM e""")
def win_04_fault_bounds(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("value") >= 10, F.col("ts")).alias("taken"))
    return rollup.fault_bounds(e, "event_id", "taken", ["user_id"]).select("event_id", "after", "before")


@query("""SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS taken FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def snk_05_upsert_latest(spark, sf_dir):
    x = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("taken"))
    newest = x.groupBy("k", "taken").agg(F.max("id").alias("id")).select("k", "id", "taken")
    half = newest.agg(F.percentile_approx("id", 0.5)).first()[0]
    return store.upsert(newest.where(F.col("id") <= half), newest.where(F.col("id") > half), ["k"], "taken")


@query("""SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE l_returnflag <> 'R' AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_returnflag = 'R' AND x.l_partkey = lineitem.l_partkey AND x.l_suppkey = lineitem.l_suppkey)""")
def snk_01_idempotent_append(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), "l_returnflag")
    return store.append_new(x.where("l_returnflag = 'R'").drop("l_returnflag"), x.where("l_returnflag <> 'R'").drop("l_returnflag"), ["part", "supplier"])


@query(cte("deps") + """, e AS (SELECT src, list_sort(list(DISTINCT dst)) AS depends_on FROM deps GROUP BY src)
SELECT 'c' || CAST(c_custkey AS STRING) AS ref, '{"type":"library","name":"' || c_name || '","version":"v1","purl":"c' || CAST(c_custkey AS STRING) || '","licence":"' || c_mktsegment || '"}' AS component, coalesce(e.depends_on, []) AS depends_on FROM customer LEFT JOIN e ON e.src = 'c' || CAST(c_custkey AS STRING)""")
def snk_07_bill_of_materials(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("ref"), F.col("c_name").alias("name"), F.lit("v1").alias("version"), F.col("c_mktsegment").alias("licence"))
    return store.bill_of_materials(c, carrier(spark, sf_dir, "deps"))


@query(cte("mods", "licences") + """, r AS (SELECT m.path, m.version, min(CASE WHEN l.expression = '' THEN 'None' WHEN l.expression LIKE '%OR%' THEN 'Ambiguous' ELSE 'Detected' END) AS status, list_sort(list(DISTINCT m.brand)) AS c FROM mods m JOIN licences l ON m.id = l.id WHERE m.size > 5 GROUP BY m.path, m.version)
SELECT d.path, d.version, CASE WHEN r.status = 'Detected' THEN array_to_string(r.c, chr(10)) END AS notice, CASE WHEN r.status IS NULL THEN 'no record' WHEN r.status IN ('None', 'Ambiguous') THEN 'licence ' || r.status END AS review
FROM (SELECT DISTINCT path, version FROM mods) d LEFT JOIN r ON r.path = d.path AND r.version = d.version""")
def snk_08_notices(spark, sf_dir):
    m = carrier(spark, sf_dir, "mods")
    status = F.when(F.col("expression") == "", "None").when(F.col("expression").contains("OR"), "Ambiguous").otherwise("Detected")
    r = m.where("size > 5").join(carrier(spark, sf_dir, "licences"), "id").groupBy("path", "version").agg(F.min(status).alias("status"), F.collect_set("brand").alias("copyrights"))
    return store.notices(m, r)


# ---- filters ----------------------------------------------------------------------------------------


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders x WHERE x.o_custkey = o.o_custkey)""")
def flt_02_latest_with_ties(spark, sf_dir):
    return compose.latest_with_ties(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '0003')""")
def flt_04_holder_contains(spark, sf_dir):
    return t(spark, sf_dir, "supplier").where(licence.holder_contains(F.col("s_name"), "0003")).select("s_suppkey", "s_name")


@query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND event_type = 'error' AND (user_id % 3 <> 0 OR user_id % 9 = 3)""")
def flt_06_ledger_predicate(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"), F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("path"), F.lit("m"), F.lit("version"), (F.col("user_id") % 9).cast("string"))).otherwise(F.create_map(F.lit("path"), F.lit("m"))).alias("payload"))
    return e.where(ledger.matches("2024-01-05 00:00:00", "2024-01-20 00:00:00", "error", "m", "3")).select("event_id")


@query("""SELECT p_partkey, p NOT LIKE '%/internal/%' AND p NOT LIKE '%/testdata/%' AS importable, p LIKE '%/testdata/%' OR p LIKE '%/\\_%' ESCAPE '\\' AS unbuilt
FROM (SELECT p_partkey, 'x/' || CASE p_size % 4 WHEN 0 THEN 'internal' WHEN 1 THEN 'testdata' WHEN 2 THEN '_old' ELSE 'pkg' END || '/y' AS p FROM part)""")
def flt_12_importable_and_unbuilt(spark, sf_dir):
    p = F.concat(F.lit("x/"), F.when(F.col("p_size") % 4 == 0, "internal").when(F.col("p_size") % 4 == 1, "testdata").when(F.col("p_size") % 4 == 2, "_old").otherwise("pkg"), F.lit("/y"))
    return t(spark, sf_dir, "part").select("p_partkey", text.is_importable(p).alias("importable"), text.is_unbuilt(p).alias("unbuilt"))


@query("""SELECT event_id, epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)) < 864000 AS fresh, CAST(floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts))) / 86400) AS BIGINT) AS age_days FROM events""")
def flt_18_freshness(spark, sf_dir):
    # looked up in whole seconds
    now, taken = F.lit("2024-01-31 00:00:00").cast("timestamp"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    return t(spark, sf_dir, "events").select("event_id", text.is_fresh(taken, now, 864000).alias("fresh"), text.age_days(taken, now).alias("age_days"))


# ---- joins ------------------------------------------------------------------------------------------


@query(cte("gens") + """, w AS (SELECT *, identity = 'sha-3' AS hit FROM gens)
SELECT module, event_id, hit AS pinned FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY hit DESC, confidence DESC, event_id) AS n FROM w) WHERE n = 1""")
def jon_04_pinned_or_served(spark, sf_dir):
    g = carrier(spark, sf_dir, "gens")
    return compose.pinned_or_served(g, ["module"], F.lit("sha-3"), F.col("identity"), [F.col("confidence").desc(), F.col("event_id")]).select("module", "event_id", "pinned")


@query(cte("mods", "advisories", "range_events") + f""", n AS (SELECT *, lead(kind) OVER w AS nk, lead(version) OVER w AS nv FROM range_events WINDOW w AS (PARTITION BY id, path ORDER BY position)),
i AS (SELECT id, path, version AS lo, CASE WHEN nk = 'fixed' THEN nv END AS hi FROM n WHERE kind = 'introduced'),
k AS (SELECT DISTINCT path, version FROM mods),
r AS (SELECT k.path, k.version, i.id, min(i.hi) AS fix FROM k JOIN i ON i.path = k.path WHERE NOT {o.valid('k.version')} OR ((i.lo = '0' OR {o.key(o.prefixed('i.lo'))} <= {o.key('k.version')}) AND (i.hi IS NULL OR {o.key('k.version')} < {o.key(o.prefixed('i.hi'))})) GROUP BY k.path, k.version, i.id),
b AS (SELECT DISTINCT id, path FROM advisories EXCEPT SELECT DISTINCT id, path FROM i)
SELECT path, version, id, fix FROM r UNION ALL SELECT k.path, k.version, b.id, NULL FROM k JOIN b ON b.path = k.path""")
def jon_09_advisory_ranges(spark, sf_dir):
    ranges = joins.intervals(carrier(spark, sf_dir, "range_events"), ["id", "path"])
    m = carrier(spark, sf_dir, "mods").select("path", F.when(F.col("version") == "latest", "vlatest").otherwise(F.col("version")).alias("version"))
    got = joins.affected(m, ranges, carrier(spark, sf_dir, "advisories"))
    return got.withColumn("version", F.when(F.col("version") == "vlatest", "latest").otherwise(F.col("version")))


@query(cte("licences", "mods") + """, a AS (SELECT m.path, m.version, l.expression AS spdx, m.id FROM mods m JOIN licences l ON m.id = l.id),
e AS (SELECT path, version, min('X-' || brand) AS s FROM mods WHERE size < 5 GROUP BY path, version), w AS (SELECT path, min('W-' || brand) AS s FROM mods WHERE size = 7 GROUP BY path)
SELECT a.id, coalesce(e.s, w.s, a.spdx) AS spdx, coalesce(e.s, w.s) IS NOT NULL AS overridden FROM a LEFT JOIN e ON e.path = a.path AND e.version = a.version LEFT JOIN w ON w.path = a.path""")
def jon_13_overrides(spark, sf_dir):
    m = carrier(spark, sf_dir, "mods")
    nodes = m.join(carrier(spark, sf_dir, "licences"), "id").select("id", "path", "version", F.col("expression").alias("spdx"))
    exact = m.where("size < 5").groupBy("path", "version").agg(F.min(F.concat(F.lit("X-"), "brand")).alias("spdx"))
    wide = m.where("size = 7").groupBy("path").agg(F.min(F.concat(F.lit("W-"), "brand")).alias("spdx")).select("path", F.lit("").alias("version"), "spdx")
    return joins.overridden(nodes, exact.unionByName(wide)).select("id", "spdx", "overridden")


@query("""WITH p AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS prefix FROM pages UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[a-z]+)/', 1) FROM pages WHERE url LIKE '%/en/%')
SELECT page_id, (SELECT prefix FROM p WHERE prefix <> '' AND (url = prefix OR starts_with(url, prefix || '/')) ORDER BY length(prefix) DESC LIMIT 1) AS prefix FROM pages""")
def jon_16_longest_prefix(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", "url")
    host = p.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("prefix"))
    folder = p.where(F.col("url").contains("/en/")).select(F.regexp_extract("url", "^(https?://[^/]+/[a-z]+)/", 1).alias("prefix"))
    return joins.longest_prefix(p, "url", host.union(folder).where("prefix <> ''"), "prefix").select("page_id", "prefix")


@query(cte("snap_a", "snap_b") + """ SELECT count(*) AS compared, count(*) FILTER (WHERE a.priority <> b.priority) AS disagreeing FROM snap_a a JOIN snap_b b ON a.k = b.k""")
def jon_18_manifest_agreement(spark, sf_dir):
    a, b = (carrier(spark, sf_dir, n).select(F.col("k").alias("path"), F.col("priority").alias("version")) for n in ("snap_a", "snap_b"))
    return joins.disagreements(a, b)


@query(cte("snap_a", "snap_b") + """ SELECT coalesce(a.k, b.k) AS k, coalesce(nullif(CASE WHEN a.status = 'O' THEN '' ELSE a.status END, ''), b.status) AS status, coalesce(a.n, b.n) AS n FROM snap_a a FULL OUTER JOIN snap_b b ON a.k = b.k""")
def jon_19_fill_merge(spark, sf_dir):
    a = carrier(spark, sf_dir, "snap_a").withColumn("status", F.when(F.col("status") == "O", "").otherwise(F.col("status")))
    return joins.fill_merge(a, carrier(spark, sf_dir, "snap_b"), ["k"], ["status", "n"])


@query("""WITH need AS (SELECT DISTINCT s_nationkey AS interface, s_suppkey % 3 AS method FROM supplier), got AS (SELECT DISTINCT l_partkey AS type, l_suppkey % 3 AS method FROM lineitem)
SELECT i.interface, g.type FROM need i JOIN got g ON i.method = g.method GROUP BY i.interface, g.type HAVING count(*) = (SELECT count(*) FROM need n WHERE n.interface = i.interface)""")
def jon_21_satisfied_interfaces(spark, sf_dir):
    need = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("interface"), (F.col("s_suppkey") % 3).alias("method"))
    return graph.satisfied(need, t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("type"), (F.col("l_suppkey") % 3).alias("method")))


@query("""WITH w AS (SELECT o_orderkey AS walk, o_orderdate AS taken FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)
SELECT walk, taken FROM w WHERE walk IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey < 20) ORDER BY taken DESC, walk DESC LIMIT 1""")
def jon_23_last_containing_walk(spark, sf_dir):
    w = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("walk"), F.col("o_orderdate").alias("taken"))
    return joins.last_containing(w, t(spark, sf_dir, "lineitem").where("l_suppkey < 20").select(F.col("l_orderkey").alias("walk")))


# ---- graphs -----------------------------------------------------------------------------------------


def _roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@query(cte("deps") + " SELECT DISTINCT src, dst, confidence FROM deps WHERE dst = 'n3'")
def grf_01_callers(spark, sf_dir):
    return graph.callers(carrier(spark, sf_dir, "deps"), "n3")


@query(cte("deps") + " SELECT DISTINCT src, dst, confidence FROM deps WHERE src = 'o7'")
def grf_02_callees(spark, sf_dir):
    return graph.callees(carrier(spark, sf_dir, "deps"), "o7")


@query(cte("deps", recursive=True) + """, b(node, d) AS (SELECT 'n3', 0 UNION SELECT src, d + 1 FROM b JOIN deps ON dst = node WHERE d < 2)
SELECT node, min(d) AS depth FROM b GROUP BY node HAVING min(d) > 0""")
def grf_03_callers_to_depth(spark, sf_dir):
    return graph.traverse(graph.reversed_edges(carrier(spark, sf_dir, "deps")), "n3", 2)[0]


@query(cte("deps", recursive=True) + """, b(node, d) AS (SELECT 'n3', 0 UNION SELECT src, d + 1 FROM b JOIN deps ON dst = node WHERE d < 2)
SELECT DISTINCT dst AS src, src AS dst FROM deps WHERE dst IN (SELECT node FROM b WHERE d < 2)""")
def grf_03_edges_to_depth(spark, sf_dir):
    return graph.traverse(graph.reversed_edges(carrier(spark, sf_dir, "deps")), "n3", 2)[1]


@query(cte("deps", recursive=True) + """, b(node) AS (SELECT 'r1' UNION SELECT dst FROM b JOIN deps ON src = node) SELECT node FROM b WHERE node <> 'r1'""")
def grf_04_closure(spark, sf_dir):
    return graph.reachable(carrier(spark, sf_dir, "deps", distinct=False), _roots(spark, "r1"))


@query(cte("deps", recursive=True) + """, b(node) AS (SELECT 'n3' UNION SELECT src FROM b JOIN deps ON dst = node) SELECT node FROM b WHERE node <> 'n3'""")
def grf_04_dependents_closure(spark, sf_dir):
    return graph.reachable(graph.reversed_edges(carrier(spark, sf_dir, "deps", distinct=False)), _roots(spark, "n3"))


@query(cte("deps") + """ SELECT DISTINCT src AS node, c_acctbal > 0 AS direct, src = 'c7' AS is_root FROM deps LEFT JOIN customer ON src = 'c' || CAST(c_custkey AS STRING) WHERE dst = 'n3'""")
def grf_05_dependents(spark, sf_dir):
    nodes = t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), (F.col("c_acctbal") > 0).alias("direct"))
    return graph.dependents(carrier(spark, sf_dir, "deps"), nodes, "n3", "c7")


@query(cte("deps", recursive=True) + """, b(node, d) AS (SELECT 'o' || CAST(o_orderkey AS STRING), 0 FROM orders WHERE o_custkey = 3 UNION SELECT dst, d + 1 FROM b JOIN deps ON src = node WHERE d < 5),
f AS (SELECT node, min(d) AS d FROM b GROUP BY node), h AS (SELECT node, d FROM f WHERE node IN ('r0', 'r1', 'r2', 'r3', 'r4')),
before AS (SELECT dst AS node, min(src) AS pred FROM deps JOIN f x ON x.node = src JOIN f y ON y.node = dst AND y.d = x.d + 1 GROUP BY dst),
p(node, place, left_over, path) AS (SELECT node, node, d, node FROM h WHERE d = (SELECT min(d) FROM h) UNION ALL SELECT p.node, pred, left_over - 1, pred || '>' || path FROM p JOIN before ON before.node = place WHERE left_over > 0)
SELECT p.node, h.d AS depth, path FROM p JOIN h ON p.node = h.node WHERE left_over = 0""")
def grf_06_shortest_path(spark, sf_dir):
    entries = t(spark, sf_dir, "orders").where("o_custkey = 3").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.shortest_path(carrier(spark, sf_dir, "deps"), entries, _roots(spark, "r0", "r1", "r2", "r3", "r4")).select("node", "depth", F.array_join("path", ">").alias("path"))


RANK = "CASE confidence WHEN 'Direct' THEN 4 WHEN 'VTA' THEN 3 WHEN 'Framework' THEN 2 WHEN 'CHA-overapprox' THEN 1 ELSE 0 END"


@query(cte("deps", recursive=True) + f""", b(node, rank) AS (SELECT 'o7', 5 UNION SELECT dst, least(rank, {RANK}) FROM b JOIN deps ON src = node)
SELECT node, max(rank) AS rank FROM b GROUP BY node""")
def grf_07_widest_path(spark, sf_dir):
    e = carrier(spark, sf_dir, "deps", distinct=False).select("src", "dst", graph.confidence_rank(F.col("confidence")).alias("rank"))
    return graph.widest_paths(e, _roots(spark, "o7")).select("node", "rank")


@query("""WITH n AS (SELECT s_suppkey AS node, s_acctbal > 0 AS owned, s_acctbal > 5000 AS exported, CASE WHEN s_suppkey % 9 = 0 THEN 'init' ELSE s_name END AS symbol FROM supplier)
SELECT node FROM n WHERE owned AND (exported OR symbol = 'init' OR NOT EXISTS (SELECT 1 FROM n WHERE owned AND (exported OR symbol = 'init')))""")
def grf_09_roots(spark, sf_dir):
    n = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_acctbal") > 0).alias("owned"), (F.col("s_acctbal") > 5000).alias("exported"), F.when(F.col("s_suppkey") % 9 == 0, "init").otherwise(F.col("s_name")).alias("symbol"))
    return graph.roots_of(n).select("node")


@query(cte("deps") + """, i AS (SELECT 'p' || CAST(p_partkey AS STRING) AS node FROM part WHERE p_brand = 'Brand#3' UNION SELECT 's' || CAST(s_suppkey AS STRING) FROM supplier) SELECT src, dst, confidence FROM deps WHERE src IN (SELECT node FROM i) AND dst IN (SELECT node FROM i)""")
def grf_10_subgraph_edges(spark, sf_dir):
    parts = t(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), "p_brand")
    sup = t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    scope = parts.where("p_brand = 'Brand#3'").select("node").union(sup)
    nodes = parts.select("node").union(sup).withColumn("original", F.lit(None).cast("string"))
    return graph.subgraph(nodes, carrier(spark, sf_dir, "deps"), scope)[1]


@query("""WITH e AS (SELECT l_partkey % 50 AS p, CAST(l_quantity AS INTEGER) AS w FROM lineitem), s AS (SELECT p, max(w) AS v FROM e GROUP BY p)
SELECT DISTINCT 'm' || CAST(e.p AS STRING) AS path, CAST(e.w AS STRING) AS wanted FROM e JOIN s ON e.p = s.p WHERE e.w <> s.v AND e.p % 2 = 1""")
def grf_11_superseded(spark, sf_dir):
    e = t(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("p"), F.col("l_quantity").cast("int").alias("w"))
    s = e.groupBy("p").agg(F.max("w").alias("v"))
    x = e.join(s, "p").select(F.concat(F.lit("m"), F.col("p").cast("string")).alias("to_path"), F.col("v").cast("string").alias("to_version"), F.col("w").cast("string").alias("wanted"))
    gone = s.where("p % 2 = 0").select(F.concat(F.lit("m"), F.col("p").cast("string")).alias("path"))
    return graph.superseded(x, gone)


@query("""WITH i AS (SELECT n_name AS interface, CASE WHEN s_acctbal > 6000 THEN s_name END AS type FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey)
SELECT DISTINCT type, true AS declared FROM i WHERE interface = (SELECT n_name FROM nation WHERE n_nationkey = 3) AND type IS NOT NULL
UNION ALL SELECT NULL, true WHERE NOT EXISTS (SELECT 1 FROM i WHERE interface = (SELECT n_name FROM nation WHERE n_nationkey = 3) AND type IS NOT NULL)""")
def grf_19_implementers(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    i = n.join(t(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("interface"), F.when(F.col("s_acctbal") > 6000, F.col("s_name")).alias("type"))
    return graph.implementers(i, n.where("n_nationkey = 3").first()["n_name"])


@query(cte("deps") + """, i AS (SELECT 'n' || CAST(s_nationkey AS STRING) AS n, min('s' || CAST(s_suppkey AS STRING)) AS sole FROM supplier GROUP BY s_nationkey HAVING count(*) = 1)
SELECT src, coalesce(sole, dst) AS dst, CASE WHEN sole IS NOT NULL THEN 'Direct' ELSE confidence END AS confidence FROM deps LEFT JOIN i ON n = dst""")
def grf_20_devirtualise(spark, sf_dir):
    i = t(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("interface"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("type"))
    return graph.devirtualise(carrier(spark, sf_dir, "deps"), i)


@query("""WITH k AS (SELECT DISTINCT p_partkey % 40 AS stem, p_size AS major FROM part), f AS (SELECT DISTINCT p_partkey % 40 AS stem, 2 AS base FROM part),
r AS (SELECT f.stem, k.major, base + row_number() OVER (PARTITION BY f.stem ORDER BY k.major) AS want FROM f JOIN k ON f.stem = k.stem WHERE k.major > base AND k.major <= base + 32)
SELECT f.stem, max(r.major) FILTER (WHERE r.major = r.want) AS last FROM f LEFT JOIN r ON f.stem = r.stem GROUP BY f.stem""")
def grf_25_newest_major(spark, sf_dir):
    p = t(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("stem"), F.col("p_size").alias("major"))
    return graph.newest_major(p, p.select("stem", F.lit(2).alias("base")).distinct())


@query(cte("deps") + """, e AS (SELECT DISTINCT src, dst, src[1:1] <> 'o' AS external FROM deps) SELECT dst AS node, count(*) FILTER (WHERE external) AS external, count(*) FILTER (WHERE NOT external) AS internal FROM e GROUP BY dst""")
def x_06_fan_in(spark, sf_dir):
    return graph.fan_in(carrier(spark, sf_dir, "deps").withColumn("external", ~F.col("src").startswith("o")))


# ---- roll-ups ---------------------------------------------------------------------------------------


@query("""SELECT l_returnflag AS pipeline, count(*) AS generations, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag""")
def agg_01_generations(spark, sf_dir):
    return rollup.generations(t(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "pipeline"), ["pipeline"], "l_linenumber")


@query("""WITH x AS (SELECT source AS k, CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 'cross-verified' WHEN quality = 1 THEN 'checksum db' ELSE 'unverified' END AS b, lang = 'fr' AS l FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id),
g AS (SELECT k, count(b) AS recorded, count(*) FILTER (WHERE l) AS local, count(*) FILTER (WHERE NOT l AND b = 'cross-verified') AS cross_verified, count(*) FILTER (WHERE NOT l AND b = 'checksum db') AS checksum_db, count(*) FILTER (WHERE NOT l AND (b IS NULL OR b = 'unverified')) AS unverified FROM x GROUP BY k)
SELECT *, cross_verified + checksum_db AS cross_verifiable, cross_verified + checksum_db > 0 AND cross_verified = 0 AS collapsed FROM g""")
def agg_03_verification_coverage(spark, sf_dir):
    x = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    b = F.when(F.col("quality").isNull(), F.lit(None)).when(F.col("toxic") == 1, "cross-verified").when(F.col("quality") == 1, "checksum db").otherwise("unverified")
    return rollup.verification_coverage(x.select(F.col("source").alias("k"), b.alias("b"), (F.col("lang") == "fr").alias("l")), ["k"], "b", "l")


@query("""SELECT lang, count(*) AS total, count(quality) AS measured, count(*) - count(quality) AS unmeasured, round(100.0 * count(quality) / count(*), 2) AS percent FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id GROUP BY lang""")
def agg_04_coverage(spark, sf_dir):
    return rollup.coverage(t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left"), ["lang"], F.col("quality").isNotNull())


@query("""WITH s AS (SELECT o_custkey AS walk, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'local_replace' ELSE 'failed' END AS status, o_orderpriority = '1-URGENT' AS is_target, o_totalprice > 490000 AS cancelled FROM orders)
SELECT walk, count(*) AS nodes, count(*) FILTER (WHERE status <> 'succeeded') AS failures, CASE WHEN bool_or(cancelled) THEN 'Cancelled' WHEN NOT coalesce(bool_or(status <> 'failed') FILTER (WHERE is_target), false) THEN 'Failed' WHEN bool_or(status = 'failed') THEN 'Partial' ELSE 'Succeeded' END AS walk_status FROM s GROUP BY walk""")
def agg_23_walk_status(spark, sf_dir):
    s = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("walk"), F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "local_replace").otherwise("failed").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("is_target"), (F.col("o_totalprice") > 490000).alias("cancelled"))
    return rollup.walk_status(s, ["walk"])


@query("""WITH s AS (SELECT user_id AS run, CASE event_type WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Unscannable' WHEN 'purchase' THEN 'Affected' ELSE 'Clean' END AS status FROM events),
g AS (SELECT run, count(*) AS total, count(*) FILTER (WHERE status = 'Failed') AS failed, count(*) FILTER (WHERE status IN ('Failed', 'Unscannable')) AS gaps, count(*) FILTER (WHERE status = 'Affected') AS affected FROM s GROUP BY run)
SELECT *, CASE WHEN failed = total THEN 'ScanFailed' WHEN gaps > 0 THEN 'Partial' WHEN affected > 0 THEN 'Affected' ELSE 'AllClean' END AS run_status FROM g""")
def agg_07_run_status(spark, sf_dir):
    s = t(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "signup", "Unscannable").when(F.col("event_type") == "purchase", "Affected").otherwise("Clean").alias("status"))
    return rollup.run_status(s, ["run"], "status")


@query("""WITH s AS (SELECT CAST(floor(event_id / 4) AS BIGINT) AS run, CASE event_type WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Unscannable' WHEN 'purchase' THEN 'Affected' ELSE 'Clean' END AS status FROM events),
g AS (SELECT run, count(*) AS total, count(*) FILTER (WHERE status = 'Failed') AS failed, count(*) FILTER (WHERE status IN ('Failed', 'Unscannable')) AS gaps, count(*) FILTER (WHERE status = 'Affected') AS affected FROM s GROUP BY run)
SELECT *, CASE WHEN failed = total THEN 'ScanFailed' WHEN gaps > 0 THEN 'Partial' WHEN affected > 0 THEN 'Affected' ELSE 'AllClean' END AS run_status FROM g""")
def agg_07_run_status_all_events(spark, sf_dir):
    s = t(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("run"), F.when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "signup", "Unscannable").when(F.col("event_type") == "purchase", "Affected").otherwise("Clean").alias("status"))
    return rollup.run_status(s, ["run"], "status")


@query("""SELECT o_custkey AS k, count(l_orderkey) AS n_findings, CASE WHEN count(l_orderkey) = 0 THEN 'Clean' WHEN bool_or(l_orderkey IS NOT NULL AND l_returnflag <> 'R') THEN 'Affected' ELSE 'Withdrawn' END AS axis FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def agg_08_findings_axis(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_orderkey").alias("f"), (F.col("l_returnflag") == "R").alias("w"))
    return rollup.findings_axis(t(spark, sf_dir, "orders").join(l, "o_orderkey", "left").withColumnRenamed("o_custkey", "k"), ["k"], "f", "w")


@query("""SELECT n_regionkey AS k, list_sort(list(DISTINCT c_mktsegment)) AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey""")
def agg_10_sorted_sets(spark, sf_dir):
    return rollup.sorted_set(t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_regionkey", "k"), ["k"], "c_mktsegment", "segments")


@query("""SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1""")
def agg_11_best_per_group(spark, sf_dir):
    return rollup.best_per_group(t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", "p_partkey")


@query(cte("gens") + """, v AS (SELECT module, identity, min(event_id) AS exemplar FROM gens WHERE identity <> '' GROUP BY module, identity) SELECT module, identity, exemplar FROM v WHERE module IN (SELECT module FROM v GROUP BY module HAVING count(*) > 1)""")
def agg_13_value_conflicts(spark, sf_dir):
    return rollup.value_conflicts(carrier(spark, sf_dir, "gens"), ["module"], "identity", "event_id")


@query("""WITH RECURSIVE l AS (
  SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, sha256('\\x00'::BLOB || o_orderkey::VARCHAR::BLOB) AS h,
    count(*) OVER (PARTITION BY o_custkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS n_leaves FROM orders
  UNION ALL SELECT o_custkey, i // 2, CASE WHEN count(*) = 1 THEN max(h) ELSE sha256('\\x01'::BLOB || unhex(min_by(h, i)) || unhex(max_by(h, i))) END, (n + 1) // 2, n_leaves
    FROM l WHERE n > 1 GROUP BY o_custkey, i // 2, n, n_leaves)
SELECT o_custkey, n_leaves, h AS root FROM l WHERE n = 1""")
def agg_20_merkle_root(spark, sf_dir):
    return rollup.merkle_roots(t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", F.col("o_orderkey").cast("string"))


# ---- windows, composition, order ----------------------------------------------------------------------


@query(cte("gens") + """ SELECT module, source, event_id FROM (SELECT *, row_number() OVER (PARTITION BY module, source ORDER BY (findings IN ('Affected', 'Withdrawn')) DESC, (coverage = 'Analysed') DESC, taken DESC, event_id DESC) AS n FROM gens) WHERE n = 1""")
def win_01_served_vulnerability(spark, sf_dir):
    r = [F.col("findings").isin("Affected", "Withdrawn").desc(), (F.col("coverage") == "Analysed").desc(), F.col("taken").desc(), F.col("event_id").desc()]
    return compose.served(carrier(spark, sf_dir, "gens"), ["module", "source"], r).select("module", "source", "event_id")


@query("""SELECT event_id, min(ts) OVER (PARTITION BY user_id, event_type) AS first_seen FROM events""")
def win_03_first_seen(spark, sf_dir):
    return rollup.first_seen(t(spark, sf_dir, "events"), ["user_id", "event_type"], "ts").select("event_id", "first_seen")


@query(cte("range_events") + """ SELECT id, path, version AS lo, CASE WHEN nk = 'fixed' THEN nv END AS hi FROM (SELECT *, lead(kind) OVER w AS nk, lead(version) OVER w AS nv FROM range_events WINDOW w AS (PARTITION BY id, path ORDER BY position)) WHERE kind = 'introduced'""")
def win_05_intervals(spark, sf_dir):
    return joins.intervals(carrier(spark, sf_dir, "range_events"), ["id", "path"])


RUNG = "CASE completeness WHEN 'BuiltWithBodies' THEN 5 WHEN 'TypeOnly' THEN 4 WHEN 'MetadataOnly' THEN 3 WHEN 'Failed' THEN 2 ELSE 1 END"


@query(cte("gens") + f""", z AS (SELECT *, {RUNG} AS rung, source IN ('view', 'click') AS zip, max(source IN ('view', 'click')) OVER (PARTITION BY module) AS any_zip FROM gens),
s AS (SELECT *, identity <> '' AS named, max(identity <> '') OVER (PARTITION BY module) AS any_named FROM z WHERE zip = any_zip),
i AS (SELECT *, max(rung) OVER (PARTITION BY module) AS top FROM s WHERE named OR NOT any_named),
c AS (SELECT module, count(*) AS generations, count(DISTINCT nullif(identity, '')) AS ids, count(DISTINCT CASE WHEN rung = top THEN findings END) AS contents FROM i GROUP BY module),
f AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY rung DESC, taken DESC, event_id) AS n FROM i)
SELECT f.module, f.event_id, c.generations, CASE WHEN c.ids > 1 THEN 'identity' WHEN c.contents > 1 THEN 'content' END AS conflict FROM f JOIN c ON f.module = c.module WHERE n = 1""")
def cmp_01_call_graph(spark, sf_dir):
    g = compose.preferred_group(carrier(spark, sf_dir, "gens"), ["module"], F.col("source").isin("view", "click"))
    g = compose.identified_or_all(g, ["module"], F.col("identity"))
    rung = compose.rank_of(F.col("completeness"), compose.COMPLETENESS)
    out = compose.served(g, ["module"], [rung.desc(), F.col("taken").desc(), F.col("event_id").asc()], F.col("identity"), F.col("findings"), rung)
    return out.select("module", "event_id", "generations", "conflict")


@query(cte("gens") + """, i AS (SELECT *, identity <> '' AS named, max(identity <> '') OVER (PARTITION BY module) AS any_named FROM gens), k AS (SELECT * FROM i WHERE named OR NOT any_named),
m AS (SELECT *, max(confidence) OVER (PARTITION BY module) - confidence <= 0.005 AS top FROM k),
c AS (SELECT module, count(*) AS generations, count(DISTINCT nullif(identity, '')) AS ids, count(DISTINCT CASE WHEN top THEN source END) AS contents FROM m GROUP BY module),
f AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY confidence DESC, taken DESC, event_id) AS n FROM m)
SELECT f.module, f.event_id, c.generations, CASE WHEN c.ids > 1 THEN 'identity' WHEN c.contents > 1 THEN 'content' END AS conflict FROM f JOIN c ON f.module = c.module WHERE n = 1""")
def cmp_09_licence(spark, sf_dir):
    from pyspark.sql import Window

    g = compose.identified_or_all(carrier(spark, sf_dir, "gens"), ["module"], F.col("identity"))
    g = g.withColumn("top", (F.max("confidence").over(Window.partitionBy("module")) - F.col("confidence") <= 0.005).cast("int"))
    out = compose.served(g, ["module"], compose.licence_ranking(F.col("confidence"), F.col("taken"), F.col("event_id")), F.col("identity"), F.col("source"), F.col("top"))
    return out.select("module", "event_id", "generations", "conflict")


@query(f"""SELECT module, event_id FROM ({cte('gens')} SELECT *, row_number() OVER (PARTITION BY module ORDER BY (findings IN ('Affected', 'Withdrawn')) DESC, (coverage = 'Analysed') DESC, {RUNG} DESC, CAST(taken AS DATE) DESC, source DESC, taken DESC, event_id) AS n FROM gens) WHERE n = 1""")
def cmp_04_vulnerability(spark, sf_dir):
    c = F.col
    r = compose.vulnerability_ranking(c("findings"), c("coverage"), compose.rank_of(c("completeness"), compose.COMPLETENESS), c("taken").cast("date"), c("source"), c("taken"), c("event_id"))
    return compose.served(carrier(spark, sf_dir, "gens"), ["module"], r).select("module", "event_id")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def srt_04_page(spark, sf_dir):
    return rollup.page(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20, 40)


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'purchase' AND value > 20) WHERE n = 1""")
def srt_09_reusable_run(spark, sf_dir):
    e = t(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 20")
    return compose.served(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id")


# ---- differences --------------------------------------------------------------------------------------


@query(cte("snap_a", "snap_b") + """ SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change, a.priority AS a_priority, b.priority AS b_priority, a.status AS a_status, b.status AS b_status
FROM snap_a a FULL OUTER JOIN snap_b b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.priority IS DISTINCT FROM b.priority OR a.status IS DISTINCT FROM b.status""")
def set_01_snapshot_diff(spark, sf_dir):
    return diff.snapshot_diff(carrier(spark, sf_dir, "snap_a"), carrier(spark, sf_dir, "snap_b"), ["k"], ["priority", "status"])


SCAN = """SELECT o_custkey % 200 AS path, o_orderkey % 7 AS finding, min(o_orderstatus) = 'P' AS withdrawn, CASE WHEN max(o_totalprice) < 300000 THEN NULL ELSE max(o_totalprice) > 450000 END AS reachable, (o_custkey % 200) % 11 <> 0 AS complete FROM {orders} WHERE """


@query("WITH old AS (" + SCAN.replace("{orders}", "orders") + "o_orderdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY ALL), new AS (" + SCAN.replace("{orders}", "orders").replace("<> 0", "<> 1") + """o_orderdate > TIMESTAMP '2000-01-01 00:00:00' GROUP BY ALL), m AS (SELECT path, min(complete) AS m FROM new GROUP BY path),
j AS (SELECT coalesce(o.path, n.path) AS path, coalesce(o.finding, n.finding) AS finding, o.path IS NULL AS no_old, n.path IS NULL AS no_new, n.withdrawn, o.complete AS c0, n.complete AS c1, o.reachable AS r0, n.reachable AS r1 FROM old o FULL OUTER JOIN new n ON o.path = n.path AND o.finding = n.finding)
SELECT j.path, finding, CASE WHEN no_old THEN 'new' WHEN no_new AND NOT coalesce(m.m, false) THEN 'unresolved' WHEN no_new THEN 'resolved' WHEN withdrawn THEN 'withdrawn' WHEN c0 <> c1 THEN 'unresolved' ELSE 'reachability-changed' END AS change
FROM j LEFT JOIN m ON m.path = j.path WHERE no_old OR no_new OR withdrawn OR c0 <> c1 OR r0 IS DISTINCT FROM r1""")
def set_02_scan_diff(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")
    group = " GROUP BY o_custkey % 200, o_orderkey % 7"
    old = spark.sql(SCAN + "o_orderdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'" + group, orders=orders)
    new = spark.sql(SCAN.replace("<> 0", "<> 1") + "o_orderdate > TIMESTAMP_NTZ '2000-01-01 00:00:00'" + group, orders=orders)
    return diff.scan_diff(old, new)


@query(cte("snap_a", "snap_b") + """ SELECT coalesce(a.priority, b.priority) AS priority, coalesce(a.status, b.status) AS status, CASE WHEN b.status IS NULL THEN 'a' WHEN a.status IS NULL THEN 'b' ELSE 'both' END AS side
FROM (SELECT DISTINCT priority, status FROM snap_a WHERE n > 1) a FULL OUTER JOIN (SELECT DISTINCT priority, status FROM snap_b WHERE status <> 'P') b ON a.priority = b.priority AND a.status = b.status""")
def set_04_sides(spark, sf_dir):
    return diff.sides(carrier(spark, sf_dir, "snap_a").where("n > 1"), carrier(spark, sf_dir, "snap_b").where("status <> 'P'"), ["priority", "status"])


@query("""WITH x AS (SELECT l_partkey AS k, coalesce(list(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'A'), []) AS a, coalesce(list(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'N'), []) AS b FROM lineitem GROUP BY l_partkey)
SELECT k, list_sort(list_filter(b, lambda v: NOT list_contains(a, v))) AS added, list_sort(list_filter(a, lambda v: NOT list_contains(b, v))) AS removed, list_sort(list_filter(a, lambda v: list_contains(b, v))) AS common FROM x""")
def set_07_list_diff(spark, sf_dir):
    of = lambda f: F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_suppkey")))
    x = t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(of("A").alias("a"), of("N").alias("b"))
    return x.select("k", diff.list_diff(F.col("a"), F.col("b")).alias("d")).select("k", "d.*")


@query("""WITH listed AS (SELECT p_partkey AS path, p_brand AS version FROM part WHERE p_size > 5), present AS (SELECT DISTINCT l_partkey AS path, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE 'd' || CAST(l_partkey % 5 AS STRING) END AS digest FROM lineitem WHERE l_quantity > 40),
required AS (SELECT p_partkey AS path, CASE WHEN p_size % 9 = 0 THEN 'other' ELSE p_brand END AS version, 'd' || CAST(p_partkey % 4 AS STRING) AS digest FROM part WHERE p_size < 45),
j AS (SELECT coalesce(l.path, p.path) AS path, l.version AS lv, p.digest AS pd, p.path IS NOT NULL AS there FROM listed l FULL OUTER JOIN present p ON l.path = p.path),
f AS (SELECT coalesce(j.path, r.path) AS path, lv, pd, coalesce(there, false) AS there, r.version AS rv, r.digest AS rd FROM j FULL OUTER JOIN required r ON j.path = r.path)
SELECT path, 'missing' AS kind FROM f WHERE lv IS NOT NULL AND NOT there UNION ALL SELECT path, 'extra' FROM f WHERE lv IS NULL AND there UNION ALL SELECT path, 'version mismatch' FROM f WHERE lv <> rv
UNION ALL SELECT path, 'unlisted requirement' FROM f WHERE rv IS NOT NULL AND lv IS NULL UNION ALL SELECT path, 'edited' FROM f WHERE pd <> rd UNION ALL SELECT path, 'unmeasured' FROM f WHERE there AND rv IS NOT NULL AND (pd IS NULL OR rd IS NULL)""")
def set_09_vendor_reconciliation(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    listed = p.where("p_size > 5").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("version"))
    present = t(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("path"), F.when(F.col("l_partkey") % 6 != 0, F.concat(F.lit("d"), (F.col("l_partkey") % 5).cast("string"))).alias("digest")).distinct()
    required = p.where("p_size < 45").select(F.col("p_partkey").alias("path"), F.when(F.col("p_size") % 9 == 0, "other").otherwise(F.col("p_brand")).alias("version"), F.concat(F.lit("d"), (F.col("p_partkey") % 4).cast("string")).alias("digest"))
    return diff.reconcile(listed, present, required)


# ---- functions ----------------------------------------------------------------------------------------


@query(cte("mods") + f""" SELECT id, {o.valid('version')} AS valid, CASE WHEN NOT {o.valid('version')} THEN -1 WHEN {o.key('version')} < {o.key("'v1.5.0'")} THEN -1 WHEN {o.key('version')} > {o.key("'v1.5.0'")} THEN 1 ELSE 0 END AS cmp,
CASE WHEN version = 'v1.5.0' THEN 'level' WHEN NOT {o.valid('version')} OR {o.key('version')} < {o.key("'v1.5.0'")} THEN 'behind' WHEN {o.key('version')} > {o.key("'v1.5.0'")} THEN 'ahead' ELSE 'level' END AS pin FROM mods""")
def fn_01_semver_compare(spark, sf_dir):
    v, to = F.col("version"), F.lit("v1.5.0")
    return carrier(spark, sf_dir, "mods").select("id", semver.is_valid(v).alias("valid"), semver.compare(v, to).alias("cmp"), semver.compare_pin(v, to).alias("pin"))


@query(cte("mods") + f""" SELECT path, version FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {o.key('version')} DESC NULLS LAST, version DESC, id) AS n FROM mods) WHERE n = 1""")
def fn_01_newest_version(spark, sf_dir):
    m = carrier(spark, sf_dir, "mods")
    return compose.served(m, ["path"], [semver.key(F.col("version")).desc_nulls_last(), F.col("version").desc(), F.col("id")]).select("path", "version")


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'example.com/a' WHEN 1 THEN 'example.com/a' WHEN 2 THEN 'gopkg.in/y' WHEN 3 THEN 'gopkg.in/y' WHEN 4 THEN 'example.com/p.v2' ELSE 'example.com/b/v1' END AS stem,
CASE p_size % 6 WHEN 0 THEN p_partkey % 30 + 2 WHEN 2 THEN p_partkey % 30 + 2 ELSE 0 END AS major, CASE WHEN p_size % 6 IN (2, 3) THEN '.v' ELSE '/v' END AS separator FROM part""")
def fn_08_module_family(spark, sf_dir):
    n, s = (F.col("p_partkey") % 30 + 2).cast("string"), F.col("p_size") % 6
    p = F.when(s == 0, F.concat(F.lit("example.com/a/v"), n)).when(s == 1, "example.com/a").when(s == 2, F.concat(F.lit("gopkg.in/y.v"), n)).when(s == 3, "gopkg.in/y").when(s == 4, "example.com/p.v2").otherwise("example.com/b/v1")
    return t(spark, sf_dir, "part").select("p_partkey", text.family(p).alias("f")).select("p_partkey", "f.stem", F.col("f.major").cast("long").alias("major"), "f.separator")


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS path, regexp_extract(url, '/([a-z]+)/[0-9]', 1) AS version, 'h' || CAST(page_id AS STRING) AS method FROM pages""")
def fn_10_coordinates(spark, sf_dir):
    c = text.coordinate(F.regexp_extract("url", "^https?://([^/]+)", 1), F.regexp_extract("url", "/([a-z]+)/[0-9]", 1))
    return t(spark, sf_dir, "pages").select("page_id", text.coordinate_path(c).alias("path"), text.coordinate_version(c).alias("version"), text.method_name(F.concat(F.lit("net/http.(*T).h"), F.col("page_id").cast("string"))).alias("method"))


@query("""SELECT doc_id, count(*) FILTER (WHERE regexp_matches(l, '(?i)^\\s*(?:[#*/;]+\\s*)?copyright\\s')) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents) GROUP BY doc_id""")
def fn_16_copyright_lines(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.size(text.copyright_lines(F.coalesce("text", F.lit("")))).cast("long").alias("n"))


@query("""SELECT doc_id, regexp_matches(text, '(?i)signed-off-by|developer certificate of origin|\\bDCO\\b') AS dco, regexp_matches(text, '(?i)contributor licen[cs]e agreement|\\bCLA\\b') AS cla FROM documents""")
def fn_17_contribution_signals(spark, sf_dir):
    s = text.contribution_signals(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", F.array_contains(s, "dco").alias("dco"), F.array_contains(s, "cla").alias("cla"))


PAIR = """CASE WHEN {d} IN ('CC-BY-4.0', '', 'MIT OR GPL-3.0-only', 'BSD-3-Clause AND MIT') THEN 'unknown_pair' WHEN {d} IN ('MIT', 'Apache-2.0', 'MPL-2.0') THEN 'compatible' WHEN target IN ('MIT', 'Apache-2.0') THEN 'incompatible' WHEN {d} = target THEN 'compatible' WHEN target = 'GPL-3.0-only' AND {d} = 'GPL-2.0-or-later' THEN 'compatible' ELSE 'unknown_pair' END"""


@query(cte("licences") + " SELECT id, " + PAIR.format(d="expression") + " AS verdict FROM licences")
def fn_23_licence_pairs(spark, sf_dir):
    return carrier(spark, sf_dir, "licences").select("id", licence.compatibility(F.col("expression"), F.col("target")).alias("verdict"))


@query(cte("licences") + """ SELECT id, CASE WHEN expression = 'MIT OR GPL-3.0-only' THEN ['GPL-3.0-only', 'MIT'] END AS arms, CASE WHEN expression = 'MIT OR GPL-3.0-only' THEN CASE WHEN target = 'GPL-3.0-only' THEN 'compatible' ELSE 'electable' END END AS verdict FROM licences""")
def fn_24_election(spark, sf_dir):
    a = licence.arms(F.col("expression"), "OR")
    return carrier(spark, sf_dir, "licences").select("id", a.alias("arms"), F.when(a.isNotNull(), licence.election(a, F.col("target"))).alias("verdict"))


@query("""WITH x AS (SELECT o_custkey AS k, list(DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'deny' WHEN '2-HIGH' THEN 'review' WHEN '3-MEDIUM' THEN 'notice' WHEN '4-NOT SPECIFIED' THEN 'allow' ELSE 'odd' END) AS c FROM orders GROUP BY o_custkey)
SELECT k, CASE WHEN k % 2 = 0 THEN CASE WHEN list_contains(c, 'allow') THEN 'allow' WHEN list_contains(c, 'notice') THEN 'notice' WHEN list_contains(c, 'review') THEN 'review' WHEN list_contains(c, 'deny') THEN 'deny' ELSE 'unknown' END
ELSE CASE WHEN list_contains(c, 'odd') THEN 'unknown' WHEN list_contains(c, 'deny') THEN 'deny' WHEN list_contains(c, 'review') THEN 'review' WHEN list_contains(c, 'notice') THEN 'notice' ELSE 'allow' END END AS policy FROM x""")
def fn_27_policy(spark, sf_dir):
    c = F.when(F.col("o_orderpriority") == "1-URGENT", "deny").when(F.col("o_orderpriority") == "2-HIGH", "review").when(F.col("o_orderpriority") == "3-MEDIUM", "notice").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "allow").otherwise("odd")
    x = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(c).alias("c"))
    return x.select("k", licence.policy(F.col("c"), F.col("k") % 2 == 0).alias("policy"))


@query(cte("mods") + f""" SELECT id, CASE WHEN size % 3 = 0 THEN CASE WHEN size % 2 = 0 THEN 'high' WHEN id % 2 = 0 THEN 'medium' ELSE 'high' END WHEN size % 3 = 1 THEN CASE WHEN NOT {o.valid('version')} OR {o.key('version')} > {o.key("'v1.5.0'")} THEN 'high' ELSE 'low' END ELSE 'unknown' END AS risk FROM mods""")
def fn_29_directive_risk(spark, sf_dir):
    s = F.col("size") % 3
    kind = F.when(s == 0, "replace").when(s == 1, "exclude").otherwise("retract")
    new = F.when(F.col("id") % 2 == 0, F.col("path")).otherwise("example.com/fork")
    return carrier(spark, sf_dir, "mods").select("id", classify.directive_risk(kind, F.col("size") % 2 == 0, new, F.col("path"), F.col("version"), F.lit("v1.5.0")).alias("risk"))


@query(cte("gens") + """ SELECT event_id, CASE WHEN findings IN ('Affected', 'Withdrawn') THEN findings WHEN coverage = 'Analysed' THEN 'Clean' ELSE coverage END AS status FROM gens""")
def fn_33_overall_status(spark, sf_dir):
    return carrier(spark, sf_dir, "gens").select("event_id", classify.overall_status(F.col("coverage"), F.col("findings")).alias("status"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 OR s_acctbal < 0 OR s_suppkey % 5 = 0 THEN 'UNRESOLVED' ELSE 'RESOLVED-ABSENT' END AS verdict, CAST((s_suppkey % 3 = 0) AS INTEGER) + CAST((s_acctbal < 0) AS INTEGER) + CAST((s_suppkey % 5 = 0) AS INTEGER) AS sinks FROM supplier""")
def fn_37_negative_verdict(spark, sf_dir):
    no, yes, k = F.lit(False), F.lit(True), F.col("s_suppkey")
    s = classify.sinks(F.col("s_name"), k % 3 == 0, no, no, F.col("s_acctbal") < 0, k % 5 != 0, yes, no)
    return t(spark, sf_dir, "supplier").select("s_suppkey", classify.negative_verdict(s).alias("verdict"), F.size(s).alias("sinks"))


@query("""SELECT n_nationkey, 'sha256:' || sha256('{"n_name":"' || n_name || '","n_regionkey":' || CAST(n_regionkey AS STRING) || '}') AS hash FROM nation""")
def fn_46_canonical_hash(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", text.canonical_hash(F.struct("n_name", "n_regionkey")).alias("hash"))
