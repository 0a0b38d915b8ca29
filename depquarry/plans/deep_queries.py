"""Queries of the operators that read stored payloads, streams and manifests, resolve graphs, pick frames and keep indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depquarry.functions import classify
from depquarry.operators import compose, frames, graph, merkle, reports, resolve, rollup, seal, staleness
from depquarry.operators.dealing import dealt
from depquarry.plans import oracle as o
from depquarry.plans.carriers import carrier, cte
from depquarry.plans.queries import RUNG, query, spread, t
from depquarry.sources import manifest, records, scanner
from depquarry.streaming import sinks

C = F.col


def s(c):
    return c.cast("string") if not isinstance(c, str) else C(c).cast("string")


# ---- Merkle proofs -----------------------------------------------------------------------------------


@query("""WITH RECURSIVE l AS (
  SELECT o_custkey AS k, 0 AS lev, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, sha256('\\x00'::BLOB || o_orderkey::VARCHAR::BLOB) AS h, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders
  UNION ALL SELECT k, lev + 1, i // 2, CASE WHEN count(*) = 1 THEN max(h) ELSE sha256('\\x01'::BLOB || unhex(min_by(h, i)) || unhex(max_by(h, i))) END, (n + 1) // 2 FROM l WHERE n > 1 GROUP BY k, lev, i // 2, n),
leaf AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders)
SELECT leaf.o_orderkey, leaf.i AS index, leaf.size, coalesce(string_agg(l.h, ',' ORDER BY l.lev), '') AS siblings, true AS proven, false AS altered
FROM leaf LEFT JOIN l ON l.k = leaf.k AND l.n > 1 AND l.i = xor(leaf.i >> l.lev, 1::BIGINT) GROUP BY ALL""")
def agg_20_merkle_proofs(spark, sf_dir):
    """The proof of every order in its customer's tree, checked with its leaf and with an altered one."""
    data = s("o_orderkey")
    p = merkle.proofs(t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", data)
    holds = lambda d: merkle.proven(d, C("index"), C("size"), C("siblings"), C("root"))
    names = F.array_join(F.transform("siblings", lambda h: F.lower(F.hex(h))), ",")
    return p.select("o_orderkey", "index", "size", names.alias("siblings"), holds(data).alias("proven"), holds(F.concat(data, F.lit("x"))).alias("altered"))


# ---- stored records ----------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN 'no payload' WHEN 2 THEN 'torn' WHEN 3 THEN 'unreadable' WHEN 4 THEN 'stale' WHEN 5 THEN 'hash differs' WHEN 6 THEN 'content differs' END AS reason,
CASE WHEN o_orderkey % 8 IN (0, 7) THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 8 IN (0, 7) THEN coalesce(lines, '') END AS lines
FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey || ':' || l_linenumber || ':' || l_returnflag, ',' ORDER BY l_partkey, l_linenumber, l_returnflag) AS lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def src_05_decoded_records(spark, sf_dir):
    """Orders as stored records with their lines as edges; six of eight were damaged, each in its own way."""
    orders = t(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), C("o_orderkey").alias("of"), "o_orderstatus", "o_orderpriority")
    edges = t(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("id"), "l_partkey", "l_linenumber", "l_returnflag")
    order = ["l_partkey", "l_linenumber"]
    stored, kept = records.encode_records(orders, ["id"], ["of", "o_orderstatus", "o_orderpriority"], edges, "id", order, 4)
    k = C("id") % 8
    # behind a condition, as a function of Python right on another's result would run that one once more
    plain = s(records.decompressed(F.when(k.isin(4, 6, 7), C("blob"))))
    damaged = (
        F.when(k == 2, F.substring("blob", 1, 20)).when(k == 3, F.lit(b"no json")).when(k == 4, F.regexp_replace(plain, '"schema_version":4', '"schema_version":3').cast("binary"))
        .when(k == 6, F.regexp_replace(plain, '"o_orderstatus":".', '"o_orderstatus":"X').cast("binary")).when(k == 7, plain.cast("binary")).when(k != 1, C("blob"))
    )
    bad = stored.select("id", damaged.alias("blob"), F.when(k == 5, "sha256:0").otherwise(C("stored_hash")).alias("stored_hash"))
    d = records.decode_records(bad, ["id"], "of bigint, o_orderstatus string, o_orderpriority string", kept, order, 4)
    line = lambda e: F.concat_ws(":", s(e["l_partkey"]), s(e["l_linenumber"]), e["l_returnflag"])
    return d.select(C("id").alias("o_orderkey"), "reason", C("record.o_orderstatus").alias("status"), F.array_join(F.transform("edges", line), ",").alias("lines"))


# ---- manifests ---------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS r FROM lineitem), c AS (SELECT l_orderkey, max(r) AS k FROM n GROUP BY l_orderkey),
x AS (SELECT o_orderkey AS id, o_orderkey % 5 AS f, o_custkey, coalesce(k, 0) AS k FROM orders LEFT JOIN c ON l_orderkey = o_orderkey),
rows AS (
  SELECT id, 1 AS line, 'module' AS kind, 'example.com/o' || id AS path, NULL AS version, NULL AS new_path, NULL AS new_version, NULL::BOOLEAN AS indirect, NULL::BOOLEAN AS local, '' AS comment, NULL AS fault FROM x
  UNION ALL SELECT id, 2, 'go', NULL, '1.' || (o_custkey % 25), NULL, NULL, NULL, NULL, '', NULL FROM x
  UNION ALL SELECT l_orderkey, 3 + r, 'require', 'example.com/p' || l_partkey, 'v1.' || (l_suppkey % 50) || '.0', NULL, NULL, l_returnflag = 'R', NULL, CASE WHEN l_returnflag = 'R' THEN 'indirect' ELSE '' END, NULL FROM n JOIN x ON id = l_orderkey
  UNION ALL SELECT id, k + 5, 'replace', 'example.com/p1', NULL, '../p1', NULL, NULL, true, '', NULL FROM x WHERE f = 0
  UNION ALL SELECT id, k + 5, 'replace', 'example.com/p2', 'v1.0.0', 'example.com/fork', 'v1.2.0', NULL, false, '', NULL FROM x WHERE f = 1
  UNION ALL SELECT id, k + 5, 'exclude', 'example.com/p3', 'v1.1.0', NULL, NULL, NULL, NULL, '', NULL FROM x WHERE f = 2
  UNION ALL SELECT id, k + 5, 'retract', NULL, 'v0.1.0', NULL, 'v0.2.0', NULL, NULL, 'bad', NULL FROM x WHERE f = 3
  UNION ALL SELECT id, k + 5, 'requires', NULL, NULL, NULL, NULL, NULL, NULL, '', 'unknown directive' FROM x WHERE f = 4)
SELECT id, CAST(line AS INT) AS line, kind, path, version, new_path, new_version, indirect, local, comment, fault FROM rows""")
def src_13_manifests(spark, sf_dir):
    """A manifest of every order, requiring its lines; each fifth has a line that no directive is."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lines = t(spark, sf_dir, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(row)).alias("of"))
    x = t(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    require = F.transform(F.coalesce("of", F.array()), lambda l: F.concat(F.lit("\texample.com/p"), s(l["l_partkey"]), F.lit(" v1."), s(l["l_suppkey"] % 50), F.lit(".0"), F.when(l["l_returnflag"] == "R", " // indirect").otherwise("")))
    f = C("o_orderkey") % 5
    last = F.when(f == 0, "replace example.com/p1 => ../p1").when(f == 1, "replace example.com/p2 v1.0.0 => example.com/fork v1.2.0").when(f == 2, "exclude example.com/p3 v1.1.0").when(f == 3, "retract [v0.1.0, v0.2.0] // bad").otherwise("requires x")
    head = F.array(F.concat(F.lit("module example.com/o"), s("o_orderkey")), F.concat(F.lit("go 1."), s(C("o_custkey") % 25)), F.lit("require ("))
    text = F.array_join(F.concat(head, require, F.array(F.lit(")"), last)), "\n")
    return manifest.parse(x.select("o_orderkey", text.alias("text")), "o_orderkey", "text")


# ---- scanner output ----------------------------------------------------------------------------------

EVENTS_SAID = """e AS (SELECT CAST(user_id % 20 AS BIGINT) AS run, event_id, 'V' || CAST(event_id % 40 AS STRING) AS id, CASE WHEN event_id % 7 = 0 THEN 'stdlib' ELSE 'm' || CAST(event_id % 7 AS STRING) END AS module,
  CASE event_type WHEN 'click' THEN '' WHEN 'purchase' THEN 'init' ELSE 'F' || CAST(event_id % 3 AS STRING) END AS function, CASE WHEN event_id % 2 = 0 THEN 'T' ELSE '' END AS receiver, CASE WHEN event_id % 5 = 0 THEN 'v1.9.0' ELSE '' END AS fixed FROM {events})"""


def scan_lines(spark, sf_dir) -> DataFrame:
    """(run, no, text): the printed messages of 20 scans, a finding for every event, then their advisories; two were cut short."""
    e = spark.sql(f"WITH {EVENTS_SAID} SELECT * FROM e", events=t(spark, sf_dir, "events"))
    frame = F.struct("module", F.lit("v1.0.0").alias("version"), F.nullif("function", F.lit("")).alias("function"), F.when(~C("function").isin("", "init"), F.nullif("receiver", F.lit(""))).alias("receiver"))
    main = F.struct(F.lit("app").alias("module"), F.lit("").alias("version"), F.lit("main").alias("function"), F.lit(None).cast("string").alias("receiver"))
    trace = F.when(C("function").isin("", "init"), F.array(frame)).otherwise(F.array(frame, main))
    finding = e.select("run", C("event_id").alias("no"), F.to_json(F.struct(F.struct(C("id").alias("osv"), F.nullif("fixed", F.lit("")).alias("fixed_version"), trace.alias("trace")).alias("finding"))).alias("text"))
    affected = lambda m, *of: F.struct(F.struct(F.lit(m).alias("name")).alias("package"), F.struct(F.array(F.struct(F.array(*[F.lit(x) for x in of]).cast("array<string>").alias("symbols"))).alias("imports")).alias("ecosystem_specific"))
    ids = e.where("id not like '%9'").select("run", "id").distinct()
    osv = ids.select("run", (F.lit(1 << 40) + F.substring("id", 2, 9).cast("long")).alias("no"), F.to_json(F.struct(F.struct("id", F.concat(F.lit("about "), "id").alias("summary"), F.array(affected("m1", "Z", "A"), affected("m2")).alias("affected")).alias("osv"))).alias("text"))
    cut = e.where("run % 10 = 3").select("run").distinct().select("run", F.lit(1 << 50).alias("no"), F.lit('{"finding": {"osv": "V1", ').alias("text"))
    whole = finding.unionByName(osv).select("run", "no", F.posexplode(F.array(F.lit("{"), F.concat(F.lit("  "), F.substring("text", F.lit(2), F.char_length("text") - 2)), F.lit("}"))).alias("i", "text"))
    return whole.select("run", (C("no") * 3 + C("i")).alias("no"), "text").unionByName(cut.withColumn("no", C("no") * 3))


@query(f"""WITH {EVENTS_SAID.replace('{events}', 'events')},
x AS (SELECT *, function NOT IN ('', 'init') AS reached, function = 'init' AS init, function = '' AS plain, CASE WHEN receiver <> '' AND function <> 'init' THEN receiver || '.' || function ELSE function END AS symbol, CASE WHEN module = 'stdlib' THEN '' ELSE 'v1.0.0' END AS version FROM e),
f AS (SELECT run, module, version, id, symbol, min(event_id) AS first FROM x WHERE reached GROUP BY ALL),
y AS (SELECT run, module, version, id, string_agg(symbol, ',' ORDER BY first) AS symbols FROM f GROUP BY ALL),
g AS (SELECT run, module, version, id, nullif(max(fixed), '') AS fixed_in, bool_or(reached) AS reachable, bool_or(init) AS init, bool_or(plain) AS plain, count(*) FILTER (WHERE reached) AS n_routes FROM x GROUP BY ALL)
SELECT g.run, g.module, g.version, g.id, fixed_in, reachable, CASE WHEN reachable OR (plain AND NOT init) THEN 'High' ELSE 'Unknown' END AS confidence,
  coalesce(y.symbols, CASE WHEN g.module = 'm1' AND g.id NOT LIKE '%9' THEN 'A,Z' ELSE '' END) AS symbols, g.module = 'm2' AND g.id NOT LIKE '%9' AS names_no_symbols, n_routes,
  CASE WHEN g.id NOT LIKE '%9' THEN 'about ' || g.id END AS summary, g.run % 10 <> 3 AS complete
FROM g LEFT JOIN y USING (run, module, version, id)""")
def src_21_scanner_findings(spark, sf_dir):
    m = scanner.read_messages(scanner.framed(scan_lines(spark, sf_dir), ["run"], "no", "text"))
    f = scanner.findings(m, ["run"])
    return f.select("run", "module", "version", "id", "fixed_in", "reachable", "confidence", F.array_join("symbols", ",").alias("symbols"), "names_no_symbols", F.size("routes").cast("long").alias("n_routes"), "summary", "complete")


@query(f"""WITH {EVENTS_SAID.replace('{events}', 'events')}, o AS (SELECT run, count(DISTINCT id) AS n FROM e WHERE id NOT LIKE '%9' GROUP BY run)
SELECT e.run, count(*) + max(coalesce(o.n, 0)) + max(CASE WHEN e.run % 10 = 3 THEN 1 ELSE 0 END) AS messages, max(coalesce(o.n, 0)) AS advisories, count(*) AS reports, CAST(max(CASE WHEN e.run % 10 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS faults
FROM e LEFT JOIN o ON o.run = e.run GROUP BY e.run""")
def src_21_scan_verdicts(spark, sf_dir):
    m = scanner.read_messages(scanner.framed(scan_lines(spark, sf_dir), ["run"], "no", "text"))
    return scanner.scan_verdicts(m, ["run"])


# ---- sinks -------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderpriority, CAST(min(o_orderkey % 3) AS INT) AS batch FROM orders GROUP BY o_custkey, o_orderpriority")
def snk_02_exactly_once(spark, sf_dir):
    """Orders in three batches, of which the second comes twice: each content is kept once, as of its first batch."""
    folder = graph.shared_path(spark, "append")
    put = sinks.append_batch(folder, "o_custkey long, o_orderpriority string", lambda: F.struct("o_custkey", "o_orderpriority"))
    rows = t(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    for batch in (0, 1, 1, 2):
        put(rows.where(C("o_orderkey") % 3 == batch).drop("o_orderkey"), batch)
    return sinks.committed(spark, folder, "o_custkey long, o_orderpriority string, hash string").drop("hash")


#: Scans of modules in their frames, with all that their ranking reads; the modules of every sixth user never state a frame.
SCANS = """scans AS (SELECT CAST(user_id AS BIGINT) AS id, 'm' || CAST(user_id AS STRING) AS module, event_id, value AS confidence, CASE WHEN user_id % 6 = 0 THEN '' WHEN event_id % 4 = 0 THEN 'isolated' WHEN event_id % 4 = 1 THEN 'target:m' || CAST(user_id AS STRING) || '@v1' WHEN event_id % 4 = 2 THEN 'target:app' || CAST(event_id % 3 AS STRING) || '@v0' ELSE '' END AS rooting,
  CASE event_type WHEN 'error' THEN 'Affected' WHEN 'purchase' THEN 'Withdrawn' ELSE 'Clean' END AS findings, CASE WHEN value < 5 THEN 'Failed' ELSE 'Analysed' END AS coverage,
  CASE WHEN value > 100 THEN 'BuiltWithBodies' WHEN value > 50 THEN 'TypeOnly' WHEN value > 20 THEN 'MetadataOnly' ELSE 'Failed' END AS completeness, date_trunc('month', ts) AS snapshot_at, 's' || CAST(event_id % 5 AS STRING) AS snapshot, ts AS taken FROM {events})"""
SCANS_SQL = SCANS.replace("{events}", "events")
RANKED = f"(findings IN ('Affected', 'Withdrawn')) DESC, (coverage = 'Analysed') DESC, {RUNG} DESC, snapshot_at DESC, snapshot DESC, taken DESC, event_id"


def scans(spark, sf_dir) -> DataFrame:
    return spark.sql(f"WITH {SCANS} SELECT * FROM scans", events=t(spark, sf_dir, "events"))


def ranking():
    return compose.vulnerability_ranking(C("findings"), C("coverage"), compose.rank_of(C("completeness"), compose.COMPLETENESS), C("snapshot_at"), C("snapshot"), C("taken"), C("event_id"))


@query(f"""WITH {SCANS_SQL}, served AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY module, rooting ORDER BY {RANKED}) AS n FROM scans) WHERE n = 1)
SELECT module, rooting, unnest(CASE findings WHEN 'Affected' THEN ['V' || (event_id % 9), 'C' || (event_id % 9)] WHEN 'Withdrawn' THEN ['V' || (event_id % 9)] ELSE [] END) AS finding_id FROM served""")
def snk_04_findings_index(spark, sf_dir):
    """The index after the scans came in three batches, one of them twice: that of the served record of each frame."""
    folder = graph.shared_path(spark, "records")
    columns = ["module", "rooting", "event_id", "findings", "coverage", "completeness", "snapshot_at", "snapshot", "taken"]
    rows = scans(spark, sf_dir).select(*columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    name = lambda kind: F.concat(F.lit(kind), s(C("event_id") % 9))
    ids = F.when(C("findings") == "Affected", F.array(name("V"), name("C"))).when(C("findings") == "Withdrawn", F.array(name("V"))).otherwise(F.array().cast("array<string>"))
    put = sinks.index_batch(f"{folder}/records", schema, f"{folder}/index", ["module", "rooting"], lambda: F.struct(*columns), ranking, ids)
    for batch in (0, 1, 1, 2):
        put(rows.where(C("event_id") % 3 == batch), batch)
    return sinks.latest(spark, f"{folder}/index", "module string, rooting string, finding_id string, gone boolean", ["module", "rooting"])


# ---- frames ------------------------------------------------------------------------------------------


@query(f"""WITH {SCANS_SQL}, q AS (SELECT *, max(rooting <> '') OVER (PARTITION BY module) AS stated FROM scans)
SELECT module, event_id FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY {RANKED}) AS n FROM q WHERE rooting = 'isolated' OR NOT stated) WHERE n = 1""")
def cmp_05_at_a_rooting(spark, sf_dir):
    return frames.at_rooting(scans(spark, sf_dir), ["module"], "rooting", F.lit("isolated"), ranking()).select("module", "event_id")


@query(f"""WITH {SCANS_SQL}, q AS (SELECT *, rooting LIKE 'target:%' AND rooting <> 'target:' || module || '@v1' AS consumer, rooting = 'isolated' AS isolated FROM scans), a AS (SELECT *, max(consumer) OVER (PARTITION BY module) AS "any" FROM q),
i AS (SELECT module, event_id FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY {RANKED}) AS n FROM a WHERE isolated AND "any") WHERE n = 1)
SELECT module, k.event_id, i.event_id AS aside FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY {RANKED}) AS n FROM a WHERE consumer OR NOT "any") k LEFT JOIN i USING (module) WHERE n = 1""")
def cmp_06_for_a_consumer(spark, sf_dir):
    return frames.for_consumer(scans(spark, sf_dir), ["module"], "rooting", F.concat("module", F.lit("@v1")), ranking()).select("module", "event_id", C("aside.event_id").alias("aside"))


@query(f"""WITH {SCANS_SQL}, q AS (SELECT *, CASE WHEN rooting = 'target:' || module || '@v1' THEN 0 WHEN rooting = 'isolated' THEN 1 ELSE 2 END AS tier, max(rooting <> '') OVER (PARTITION BY module) AS stated FROM scans)
SELECT module, event_id FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY tier, {RANKED}) AS n FROM q WHERE tier < 2 OR NOT stated) WHERE n = 1""")
def cmp_07_for_a_tree(spark, sf_dir):
    return frames.for_tree(scans(spark, sf_dir), ["module"], "rooting", C("module"), ranking()).select("module", "event_id")


@query(f"""WITH {SCANS_SQL}, x AS (SELECT event_id, rooting, module, CASE event_id % 3 WHEN 0 THEN module WHEN 1 THEN 'app' || (event_id % 3) ELSE '' END AS fp, CASE event_id % 5 WHEN 0 THEN '' ELSE 'v' || (event_id % 5) END AS fv FROM scans)
SELECT event_id, CASE WHEN fp = '' THEN NULL WHEN regexp_extract(rooting, '^target:(.*)@[^@]*$', 1) = fp THEN substr(rooting, 8) WHEN fv <> '' THEN fp || '@' || fv WHEN module = fp THEN module || '@v7' END AS start FROM x""")
def x_07_route_start(spark, sf_dir):
    e = C("event_id")
    x = scans(spark, sf_dir).withColumn("fp", F.when(e % 3 == 0, C("module")).when(e % 3 == 1, F.concat(F.lit("app"), s(e % 3))).otherwise("")).withColumn("fv", F.when(e % 5 == 0, "").otherwise(F.concat(F.lit("v"), s(e % 5))))
    return x.select("event_id", frames.route_start(C("rooting"), C("fp"), C("fv"), C("module"), F.lit("v7")).alias("start"))


@query(f"""WITH {SCANS_SQL} SELECT event_id, nullif(rooting, '') AS plain, CASE WHEN event_id % 2 = 0 THEN 'isolated' ELSE rooting END AS stated FROM scans""")
def x_13_stamped_rooting(spark, sf_dir):
    """Two findings of every scan: one whose answer states no frame, one that states its own at times; the absent answer stays so."""
    answer = lambda r: F.struct(F.lit(True).alias("ok"), r.alias("rooting"))
    findings = F.array(F.struct(answer(F.lit(None).cast("string")).alias("reachable")), F.struct(answer(F.when(C("event_id") % 2 == 0, "isolated").otherwise("")).alias("reachable")))
    x = scans(spark, sf_dir).select("event_id", frames.with_rooting(findings, "reachable", C("rooting")).alias("f"))
    return x.select("event_id", F.nullif(C("f")[0]["reachable"]["rooting"], F.lit("")).alias("plain"), C("f")[1]["reachable"]["rooting"].alias("stated"))


@query("""WITH w AS (SELECT c_custkey AS walk, c_custkey % 3 <> 0 AS local, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/gone' ELSE '/p' || c_nationkey END AS dir FROM customer), there AS (SELECT '/p' || n_nationkey AS dir FROM nation WHERE n_regionkey < 3),
newest AS (SELECT walk, run FROM (SELECT o_custkey AS walk, o_orderkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1),
r AS (SELECT l_orderkey AS run, l_partkey AS module, CASE l_returnflag WHEN 'A' THEN 'isolated' WHEN 'N' THEN 'target:app@v0' ELSE '' END AS rooting, CASE WHEN l_linenumber < 4 THEN 's2' ELSE 's1' END AS snapshot, CASE l_linestatus WHEN 'O' THEN 'complete' ELSE 'failed' END AS status, l_linenumber AS n, l_suppkey AS k FROM lineitem),
rooted AS (SELECT DISTINCT walk FROM newest JOIN r USING (run) WHERE rooting LIKE 'target:%'),
x AS (SELECT w.*, CASE WHEN local AND dir <> '' THEN dir END AS root, CASE WHEN local AND dir <> '' AND dir NOT IN (FROM there) THEN 'the project''s folder can''t be read from here' WHEN local AND dir = '' AND walk IN (FROM rooted) THEN 'the run was rooted at a project whose folder is not known' END AS reason FROM w),
m AS (SELECT DISTINCT o_custkey AS walk, l_partkey AS module FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
f AS (SELECT walk, module FROM (SELECT walk, module, snapshot, status, row_number() OVER (PARTITION BY walk, module ORDER BY n DESC, k, snapshot, status) AS i FROM newest JOIN r USING (run) JOIN x USING (walk) WHERE CASE WHEN root IS NOT NULL THEN rooting LIKE 'target:%' ELSE rooting = 'isolated' END) WHERE i = 1 AND snapshot = 's2' AND status = 'complete')
SELECT m.walk, m.module, CASE WHEN reason IS NOT NULL THEN 'refuse' WHEN f.walk IS NOT NULL THEN 'reuse' ELSE 'rescan' END AS action, CASE WHEN reason IS NULL THEN root END AS root,
  coalesce(reason, CASE WHEN f.walk IS NOT NULL THEN 'the served record is complete and of this snapshot' WHEN root IS NOT NULL THEN 'in the project''s frame' WHEN local THEN 'isolated, as before' ELSE 'a published module' END) AS reason
FROM m JOIN x ON x.walk = m.walk LEFT JOIN f ON f.walk = m.walk AND f.module = m.module""")
def x_18_rescan_plan(spark, sf_dir):
    k, l, orders = C("c_custkey"), t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "orders")
    walks = t(spark, sf_dir, "customer").select(k.alias("walk"), (k % 3 != 0).alias("local"), F.when(k % 4 == 0, "").when(k % 4 == 1, "/gone").otherwise(F.concat(F.lit("/p"), s("c_nationkey"))).alias("project_dir"))
    modules = orders.join(l, C("l_orderkey") == C("o_orderkey")).select(C("o_custkey").alias("walk"), C("l_partkey").alias("module"))
    runs = orders.select(C("o_custkey").alias("walk"), C("o_orderkey").alias("run"), C("o_orderdate").alias("at"))
    rooting = F.when(C("l_returnflag") == "A", "isolated").when(C("l_returnflag") == "N", "target:app@v0").otherwise("")
    recs = l.select(C("l_orderkey").alias("run"), C("l_partkey").alias("module"), rooting.alias("rooting"), F.when(C("l_linenumber") < 4, "s2").otherwise("s1").alias("snapshot"), F.when(C("l_linestatus") == "O", "complete").otherwise("failed").alias("status"), "l_linenumber", "l_suppkey")
    there = t(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.concat(F.lit("/p"), s("n_nationkey")).alias("project_dir"))
    return frames.rescan(walks, modules, runs, recs, there, "s2", [C("l_linenumber").desc(), C("l_suppkey").asc(), C("snapshot").asc(), C("status").asc()], force=False)


# ---- staleness ---------------------------------------------------------------------------------------

NOW = "2024-06-01 12:00:00"


@query(cte("mods") + f""", a AS (SELECT DISTINCT path, version AS pinned, CAST(replace(path, 'example.com/m', '') AS BIGINT) AS k FROM mods), parts AS (SELECT DISTINCT p_partkey % 40 AS k FROM part),
l AS (SELECT k, 'v1.5.0' AS latest, k % 4 <> 0 AS probed, 2 + k % 2 AS from_major, CASE WHEN k % 3 = 1 THEN 9 END AS newer_major, CASE WHEN k % 3 = 1 THEN 'v9.0.0' END AS newer_version, k % 3 = 0 AS asked_again, CASE WHEN k % 6 = 0 THEN 'v2.0.0' END AS again_version, TIMESTAMP '{NOW}' - k * INTERVAL 1 HOUR AS looked FROM parts WHERE k % 8 <> 7),
p AS (SELECT p_partkey % 40 AS k, 2 + p_size % 5 AS major, CASE WHEN (p_partkey % 40 + 2 + p_size % 5) % 7 = 0 THEN NULL ELSE 'v' || (2 + p_size % 5) || '.0.0' END AS v FROM part GROUP BY ALL),
x AS (SELECT a.*, l.* EXCLUDE (k), coalesce(k < 24 AND l.latest IS NOT NULL, false) AS fresh FROM a LEFT JOIN l USING (k)),
y AS (SELECT *, CASE WHEN fresh THEN latest WHEN k % 5 <> 0 THEN 'v1.8.0' END AS lt, CASE WHEN {o.valid('pinned')} THEN CAST(regexp_extract(pinned, '^v([0-9]+)', 1) AS BIGINT) ELSE 0 END AS own FROM x),
z AS (SELECT *, greatest(own, 1) + 1 AS start, CASE WHEN own >= 2 AND pinned LIKE '%+incompatible' THEN own END AS same FROM y),
s AS (SELECT *, fresh AND probed AND from_major = start AND (same IS NULL OR asked_again) AS whole FROM z),
r AS (SELECT path, pinned, min(CASE WHEN v IS NULL THEN major END) AS bad, max(major) AS top, max_by(v, major) AS tv FROM (SELECT s.path, s.pinned, s.start, p.major, p.v, row_number() OVER (PARTITION BY s.path, s.pinned ORDER BY p.major) AS n FROM s JOIN p ON p.k = s.k AND p.major >= s.start WHERE NOT s.whole AND lt IS NOT NULL) WHERE major = start + n - 1 GROUP BY ALL),
w AS (SELECT s.*, r.bad, r.top, r.tv, p.v AS av, r.bad IS NULL AND NOT (p.k IS NOT NULL AND p.v IS NULL) AS ok FROM s LEFT JOIN r USING (path, pinned) LEFT JOIN p ON p.k = s.k AND p.major = s.same)
SELECT path, pinned, CASE WHEN whole THEN 'ledger' WHEN fresh THEN 'mixed' ELSE 'live' END AS source, lt AS latest, CASE WHEN lt IS NOT NULL THEN CASE WHEN whole THEN true ELSE ok END END AS probed, CASE WHEN lt IS NOT NULL THEN CASE WHEN whole THEN from_major ELSE start END END AS from_major,
  CASE WHEN lt IS NOT NULL THEN CASE WHEN whole THEN newer_major WHEN ok THEN top END END AS newer_major, CASE WHEN lt IS NOT NULL THEN CASE WHEN whole THEN newer_version WHEN ok THEN tv END END AS newer_version,
  CASE WHEN lt IS NOT NULL THEN CASE WHEN whole THEN asked_again ELSE ok AND same IS NOT NULL END END AS asked_again, CASE WHEN lt IS NOT NULL THEN CASE WHEN whole THEN again_version WHEN ok THEN av END END AS again_version, CASE WHEN lt IS NULL THEN 'lookup failed' END AS error
FROM w""")
def x_09_staleness(spark, sf_dir):
    """Every pinned version against a ledger of two days, lookups of four paths in five, and majors of which some probes fail."""
    part, now = t(spark, sf_dir, "part"), F.lit(NOW).cast("timestamp")
    k = C("p_partkey") % 40
    name = lambda c: F.concat(F.lit("example.com/m"), s(c))
    paths = part.select(k.alias("k")).distinct()
    k = C("k")
    ledger = paths.where(k % 8 != 7).select(
        name(k).alias("path"), F.lit("v1.5.0").alias("latest"), now.alias("latest_at"), F.timestamp_seconds(F.unix_timestamp(now) - k * 3600).alias("looked_up_at"), (k % 4 != 0).alias("probed"), (2 + k % 2).alias("from_major"),
        F.when(k % 3 == 1, F.lit(9).cast("long")).alias("newer_major"), F.when(k % 3 == 1, "v9.0.0").alias("newer_version"), (k % 3 == 0).alias("asked_again"), F.when(k % 6 == 0, "v2.0.0").alias("again_version"),
    )
    latest = paths.where(k % 5 != 0).select(name(k).alias("path"), F.lit("v1.8.0").alias("version"), now.alias("at"))
    majors = part.select((C("p_partkey") % 40).alias("k"), (2 + C("p_size") % 5).cast("long").alias("major")).distinct()
    published = majors.select(name(k).alias("stem"), "major", F.when((k + C("major")) % 7 != 0, F.concat(F.lit("v"), s("major"), F.lit(".0.0"))).alias("version"))
    asked = carrier(spark, sf_dir, "mods").select("path", C("version").alias("pinned"))
    answers, _ = staleness.resolve(asked, ledger, latest, published, now, 24 * 3600)
    return answers.drop("latest_at", "looked_up_at")


# ---- sealed records ----------------------------------------------------------------------------------

SEALED = {"findings": ["id", "affected_symbols", "references"], "findings[].affected_symbols": [], "findings[].references": ["type", "url"], "findings[].route": seal.MEANING}


@query("""WITH f AS (SELECT l_orderkey, 'V' || (l_partkey % 4) AS id, list_sort(['s' || (l_suppkey % 5), 'a' || l_linenumber]) AS sy, CASE WHEN l_returnflag = 'R' THEN ['FIX:u' || (l_suppkey % 3), 'WEB:u' || (l_partkey % 3)] ELSE ['WEB:u' || (l_suppkey % 3)] END AS refs, [l_suppkey % 9, l_partkey % 9] AS route FROM lineitem)
SELECT l_orderkey, string_agg(id || '/' || array_to_string(sy, ' ') || '/' || array_to_string(refs, ' ') || '/' || array_to_string(route, ' '), ';' ORDER BY id, sy, refs, route) AS findings FROM f GROUP BY l_orderkey""")
def srt_03_sealed_records(spark, sf_dir):
    """Orders' lines as findings with symbols, references and a route each, collected as they come, then sealed."""
    ref = lambda kind, n: F.struct(F.concat(F.lit("u"), s(n % 3)).alias("url"), F.lit(kind).alias("type"))
    web = ref("WEB", C("l_partkey"))
    refs = F.when(C("l_returnflag") == "R", F.array(web, ref("FIX", C("l_suppkey")))).otherwise(F.array(ref("WEB", C("l_suppkey"))))
    symbols = F.array(F.concat(F.lit("s"), s(C("l_suppkey") % 5)), F.concat(F.lit("a"), s("l_linenumber")))
    f = F.struct(F.concat(F.lit("V"), s(C("l_partkey") % 4)).alias("id"), symbols.alias("affected_symbols"), refs.alias("references"), F.array(C("l_suppkey") % 9, C("l_partkey") % 9).alias("route"))
    x = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(f).alias("findings"))
    x = seal.sealed(x, ["findings"], SEALED)
    of = lambda r: F.concat_ws("/", r["id"], F.array_join(r["affected_symbols"], " "), F.array_join(F.transform(r["references"], lambda q: F.concat_ws(":", q["type"], q["url"])), " "), F.array_join(F.transform(r["route"], s), " "))
    return x.select("l_orderkey", F.array_join(F.transform("findings", of), ";").alias("findings"))


# ---- version selection -------------------------------------------------------------------------------

LINES = """e AS (SELECT l_orderkey % 300 AS a, l_partkey % 300 AS b, l_suppkey % 4 AS rv, l_linenumber <= 2 AS old FROM lineitem WHERE l_orderkey % 300 <> l_partkey % 300),
req AS (SELECT DISTINCT least(a, b) AS p, least(a, b) % 4 AS v, greatest(a, b) AS rp, rv, old FROM e), root AS (SELECT CAST(substr(min('m' || p), 2) AS BIGINT) AS p FROM req), direct AS (SELECT DISTINCT rp FROM req, root WHERE req.p = root.p AND v = root.p % 4)"""
WAVES = f"""WITH RECURSIVE {LINES}, best(own, v, depth, expand, go) USING KEY (own) AS (
  SELECT p, p % 4, 0, true, true FROM root
  UNION
  SELECT own, CASE WHEN won THEN av ELSE cv END, CASE WHEN cd IS NULL THEN ad ELSE least(cd, ad) END, ce OR ae, (ce OR ae) AND (won OR NOT ce) FROM (
    SELECT a.own, a.av, a.ad, a.ae, c.v AS cv, c.depth AS cd, coalesce(c.expand, false) AS ce, c.own IS NULL OR a.av > c.v AS won FROM (
      SELECT r.rp AS own, max(r.rv) AS av, min(b.depth + 1) AS ad, bool_or(r.old OR r.rp IN (SELECT rp FROM direct)) AS ae FROM best b JOIN req r ON r.p = b.own AND r.v = b.v WHERE b.go GROUP BY r.rp) a
    LEFT JOIN recurring.best c ON c.own = a.own)
  WHERE won OR (ae AND NOT ce) OR ad < cd)"""


def required(spark, sf_dir) -> DataFrame:
    """Each line an edge from the smaller module to the larger, so there are no cycles."""
    a, b = C("l_orderkey") % 300, C("l_partkey") % 300
    v, name = lambda c: F.concat(F.lit("v1."), s(c % 4), F.lit(".0")), lambda c: F.concat(F.lit("m"), s(c))
    return t(spark, sf_dir, "lineitem").where(a != b).select(name(F.least(a, b)).alias("path"), v(F.least(a, b)).alias("version"), name(F.greatest(a, b)).alias("req_path"), v(C("l_suppkey")).alias("req_version"), F.when(C("l_linenumber") > 2, "1.21").otherwise("1.16").alias("go_version"))


@query(WAVES + " SELECT 'm' || own AS path, 'v1.' || v || '.0' AS version, depth, false AS pinned FROM best")
def grf_13_version_selection(spark, sf_dir):
    r = required(spark, sf_dir)
    first = r.agg(F.min(F.struct("path", "version")).alias("x")).first()["x"]
    return resolve.select_versions(r, (first["path"], first["version"]))[0]


@query()
def grf_14_replaced_graph(spark, sf_dir):
    """The same graph with modules replaced by others and by folders, versions excluded and manifests that can't be read."""
    r = required(spark, sf_dir)
    first = r.agg(F.min(F.struct("path", "version")).alias("x")).first()["x"]
    k = F.substring("req_path", 2, 9).cast("long")
    paths = r.select("req_path", k.alias("k")).distinct()
    old = F.when(C("k") % 22 == 0, "").otherwise("v1.2.0")
    replaces = paths.where(C("k") % 11 == 0).select(C("req_path").alias("old_path"), old.alias("old_version"), F.when(C("k") % 33 == 0, "../local").otherwise(F.concat(F.lit("m"), s((C("k") + 7) % 300))).alias("new_path"), F.when(C("k") % 33 == 0, "").otherwise("v1.3.0").alias("new_version"), (C("k") % 33 == 0).alias("local"))
    excludes = paths.where(C("k") % 13 == 0).select(C("req_path").alias("path"), F.lit("v1.1.0").alias("version"))
    failures = paths.where(C("k") % 17 == 5).select(C("req_path").alias("path"), F.explode(F.array(*[F.lit(f"v1.{i}.0") for i in range(4)])).alias("version"), F.lit("fetch_failed").alias("reason"))
    nodes, _, state = resolve.resolve_graph(r, (first["path"], first["version"]), replaces, excludes, failures, max_depth=3)
    told = state.first()
    return nodes.withColumn("partial", F.lit(told["partial"])).withColumn("reasons", F.lit(", ".join(told["reasons"])))




# ---- reports -----------------------------------------------------------------------------------------

SPDX = {0: "MIT", 1: "Apache-2.0", 2: "GPL-3.0-only", 3: "AGPL-3.0-only", 4: "MPL-2.0", 5: "CC-BY-4.0", 6: "Vendor-1.0", 7: ""}


@query("""WITH s(i, id) AS (VALUES (0, 'MIT'), (1, 'Apache-2.0'), (2, 'GPL-3.0-only'), (3, 'AGPL-3.0-only'), (4, 'MPL-2.0'), (5, 'CC-BY-4.0'), (6, 'Vendor-1.0'), (7, '')),
i AS (SELECT l_orderkey AS walk, 'p' || l_partkey AS path, CASE WHEN o_orderpriority = '1-URGENT' THEN 'MIT' WHEN o_orderpriority = '2-HIGH' THEN 'GPL-3.0-only' ELSE 'Apache-2.0' END AS target, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE (SELECT id FROM s WHERE s.i = l_partkey % 8) END AS spdx, l_partkey % 11 = 0 AS choice,
  CASE WHEN l_partkey % 22 = 0 THEN ['AGPL-3.0-only', 'GPL-3.0-only'] ELSE ['GPL-3.0-only', 'MIT'] END AS arms FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
v AS (SELECT *, CASE WHEN choice THEN CASE WHEN target = 'GPL-3.0-only' THEN CASE WHEN arms[1] = 'AGPL-3.0-only' THEN 'electable' ELSE 'compatible' END WHEN arms[2] = 'MIT' THEN 'electable' ELSE 'incompatible' END
  WHEN spdx IN ('', 'CC-BY-4.0', 'Vendor-1.0') THEN 'unknown_pair' WHEN spdx IN ('MIT', 'Apache-2.0', 'MPL-2.0') THEN 'compatible' WHEN spdx = target THEN 'compatible' WHEN target = 'GPL-3.0-only' THEN 'unknown_pair' ELSE 'incompatible' END AS verdict,
  CASE WHEN choice THEN array_to_string(arms, ' OR ') ELSE spdx END AS dep FROM i),
k AS (SELECT *, CASE WHEN verdict = 'electable' THEN 'election_required' WHEN verdict = 'unknown_pair' THEN 'unknown_pair' WHEN dep LIKE 'AGPL%' THEN 'network_trigger' ELSE 'copyleft_propagation' END AS kind FROM v WHERE verdict <> 'compatible'),
c AS (SELECT walk, string_agg(path || ':' || dep || ':' || verdict || ':' || kind || ':' || CASE WHEN dep = '' THEN 'unmeasured' ELSE 'classified' END, ';' ORDER BY path, dep) AS conflicts FROM k GROUP BY walk),
h AS (SELECT walk, string_agg(spdx || ':' || n || ':' || CASE WHEN spdx = 'CC-BY-4.0' THEN 'true' ELSE 'false' END, ';' ORDER BY spdx) AS holes FROM (SELECT walk, spdx, count(DISTINCT path) AS n FROM i WHERE spdx IN ('CC-BY-4.0', 'Vendor-1.0') GROUP BY ALL) GROUP BY walk)
SELECT walk, max(target) AS target, c.walk IS NULL AS clean, coalesce(conflicts, '') AS conflicts, coalesce(holes, '') AS holes FROM i LEFT JOIN c USING (walk) LEFT JOIN h USING (walk) GROUP BY ALL""")
def fn_25_closure_reports(spark, sf_dir):
    """The licence closure of every order against a target of its own."""
    p = C("l_partkey")
    target = F.when(C("o_orderpriority") == "1-URGENT", "MIT").when(C("o_orderpriority") == "2-HIGH", "GPL-3.0-only").otherwise("Apache-2.0")
    one = F.coalesce(*[F.when(p % 8 == k, v) for k, v in SPDX.items()])
    arms = F.when(p % 22 == 0, F.array(F.lit("AGPL-3.0-only"), F.lit("GPL-3.0-only"))).when(p % 11 == 0, F.array(F.lit("GPL-3.0-only"), F.lit("MIT")))
    l = spread(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")
    x = l.join(t(spark, sf_dir, "orders"), C("o_orderkey") == C("l_orderkey"))
    i = x.select(C("l_orderkey").alias("walk"), F.concat(F.lit("p"), s(p)).alias("path"), F.lit("v1").alias("version"), F.when(p % 11 != 0, one).alias("spdx"), arms.alias("arms"), F.lit("unmeasured").alias("measurement"), target.alias("target")).distinct()
    r = reports.closure_report(i, ["walk"])
    conflict = lambda c: F.concat_ws(":", c["path"], c["dep"], c["verdict"], c["kind"], c["measurement"])
    hole = lambda h: F.concat_ws(":", h["spdx"], s(h["modules"]), s(h["deliberate"]))
    joined = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ";"), F.lit(""))
    return r.select("walk", "target", "clean", joined("conflicts", conflict).alias("conflicts"), joined("holes", hole).alias("holes"))


@query("""WITH x AS (SELECT o_custkey AS walk, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CASE l_partkey % 6 WHEN 0 THEN 'Verified' WHEN 1 THEN 'VerifiedBySumDBOnly' WHEN 2 THEN 'VerifiedByGoSum' WHEN 3 THEN 'UnverifiedNoVCS' WHEN 4 THEN 'LocalSource' ELSE 'odd' END END AS st, l_linenumber AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
y AS (SELECT walk, CASE WHEN st IS NULL THEN 'unrecorded' WHEN st = 'Verified' THEN 'cross_verified' WHEN st = 'VerifiedBySumDBOnly' THEN 'checksum_db' WHEN st = 'VerifiedByGoSum' THEN 'go_sum' WHEN st = 'UnverifiedNoVCS' THEN 'unverified' WHEN st = 'LocalSource' THEN 'local_source' ELSE 'unrecognised' END AS c, CASE WHEN n = 1 THEN 'not_measured' WHEN n = 2 THEN 'never' WHEN n = 3 THEN 'inherited' WHEN n = 4 THEN 'never' ELSE 'rechecked' END AS e FROM x),
g AS (SELECT walk, count(*) AS total, count(*) FILTER (c = 'cross_verified') AS cross_verified, count(*) FILTER (c = 'checksum_db') AS checksum_db, count(*) FILTER (c = 'go_sum') AS go_sum, count(*) FILTER (c = 'unverified') AS unverified, count(*) FILTER (c = 'local_source') AS local_source, count(*) FILTER (c = 'unrecognised') AS unrecognised, count(*) FILTER (c = 'unrecorded') AS unrecorded,
  count(*) FILTER (e = 'rechecked' AND c NOT IN ('unrecorded', 'local_source')) AS vcs_rechecked, count(*) FILTER (e = 'inherited' AND c NOT IN ('unrecorded', 'local_source')) AS vcs_inherited, count(*) FILTER (e = 'never' AND c NOT IN ('unrecorded', 'local_source')) AS vcs_never, count(*) FILTER (e = 'not_measured' AND c NOT IN ('unrecorded', 'local_source')) AS vcs_not_measured FROM y GROUP BY walk)
SELECT *, total - unrecorded AS recorded, total - unrecorded - local_source AS cross_verifiable, total - unrecorded - local_source > 0 AND cross_verified = 0 AS collapsed FROM g""")
def agg_03_verification_evidence(spark, sf_dir):
    """How the lines of each customer's orders were verified, and what their legs say of version control."""
    p, n = C("l_partkey") % 6, C("l_linenumber")
    status = F.when(C("l_suppkey") % 9 != 0, F.when(p == 0, "Verified").when(p == 1, "VerifiedBySumDBOnly").when(p == 2, "VerifiedByGoSum").when(p == 3, "UnverifiedNoVCS").when(p == 4, "LocalSource").otherwise("odd"))
    leg = lambda kind, how: F.struct(F.lit(kind).alias("kind"), F.lit(how).alias("provenance"))
    legs = F.when(n == 2, F.array(leg("sum", "rechecked"))).when(n == 3, F.array(leg("sum", "rechecked"), leg("vcs", "inherited"))).when(n == 4, F.array(leg("vcs", "absent"))).when(n > 4, F.array(leg("vcs", "odd"), leg("vcs", "rechecked")))
    x = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), C("o_orderkey") == C("l_orderkey"))
    return reports.verification_report(x.select(C("o_custkey").alias("walk"), status.alias("status"), legs.alias("legs")), ["walk"], "status", "legs")


USE_NODES = """n AS (SELECT DISTINCT l_orderkey AS walk, 'p' || l_partkey AS path, CASE WHEN l_partkey % 7 = 0 THEN 'stdlib' WHEN l_partkey % 7 = 1 THEN 'local_replace' ELSE 'mvs' END AS source FROM lineitem)"""


def _use(spark, sf_dir, recursive):
    p = C("l_partkey")
    source = F.when(p % 7 == 0, "stdlib").when(p % 7 == 1, "local_replace").otherwise("mvs")
    nodes = t(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("walk"), F.concat(F.lit("p"), s(p)).alias("path"), F.lit("v1").alias("version"), source.alias("source"))
    targets = t(spark, sf_dir, "orders").select(C("o_orderkey").alias("walk"), F.concat(F.lit("p"), s(C("o_custkey") % 200)).alias("path"), F.lit("v1").alias("version"))
    return reports.use_selection(nodes, targets, recursive)


@query(f"WITH {USE_NODES} SELECT walk, path, 'v1' AS version, source, source = 'mvs' AS copied FROM n")
def cmd_22_use_recursive(spark, sf_dir):
    return _use(spark, sf_dir, True)


@query(f"""WITH {USE_NODES} SELECT o_orderkey AS walk, 'p' || (o_custkey % 200) AS path, 'v1' AS version, coalesce(source, 'target') AS source, coalesce(source, 'target') IN ('mvs', 'target') AS copied FROM orders LEFT JOIN n ON walk = o_orderkey AND path = 'p' || (o_custkey % 200)""")
def cmd_22_use_target(spark, sf_dir):
    return _use(spark, sf_dir, False)


CONTEXT = """nodes AS (SELECT DISTINCT p_partkey AS id FROM part), ev AS (SELECT CAST(user_id AS BIGINT) AS id, event_id, event_type, ts, value FROM events),
fac AS (SELECT id, event_id, CASE WHEN value > 20 THEN 'ok' ELSE 'weak' END AS status, ts, count(*) OVER (PARTITION BY id) AS g, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id) AS n FROM ev WHERE event_type = 'view'),
lic AS (SELECT id, event_id, 'Detected' AS status, event_id % 3 <> 0 AS ok, ts, count(*) OVER (PARTITION BY id) AS g, row_number() OVER (PARTITION BY id ORDER BY (event_id % 3 <> 0) DESC, ts DESC, event_id) AS n FROM ev WHERE event_type = 'purchase')"""


def _context(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(C("user_id").cast("long").alias("id"), "event_id", "event_type", "ts", "value")
    fetch = e.where("event_type = 'view'").select("id", F.when(C("value") > 20, "ok").otherwise("weak").alias("status"), "event_id", "ts")
    lic = e.where("event_type = 'purchase'").select("id", F.lit("Detected").alias("status"), "event_id", "ts")
    newest = [C("ts").desc(), C("event_id").asc()]
    modules = t(spark, sf_dir, "part").select(C("p_partkey").alias("id"))
    return reports.context(modules, ["id"], {"verification": (fetch, newest), "licence": (lic, newest)}, {"licence": C("event_id") % 3 != 0})


@query(f"""WITH {CONTEXT} SELECT nodes.id, coalesce(f.status, 'not_run') AS verification, coalesce(f.g, 0) AS fetches, f.event_id AS fetched, CASE WHEN l.id IS NULL THEN 'not_run' WHEN l.ok THEN l.status ELSE 'superseded' END AS licence, coalesce(l.g, 0) AS extractions, CASE WHEN l.ok THEN l.event_id END AS extraction,
CASE WHEN f.id IS NULL THEN 0 ELSE 1 END + CASE WHEN coalesce(l.ok, false) THEN 1 ELSE 0 END AS measured FROM nodes LEFT JOIN fac f ON f.id = nodes.id AND f.n = 1 LEFT JOIN lic l ON l.id = nodes.id AND l.n = 1""")
def cmd_12_module_context(spark, sf_dir):
    v, l = "verification", "licence"
    return _context(spark, sf_dir).select("id", C(f"{v}.status").alias(v), C(f"{v}.generations").alias("fetches"), C(f"{v}.event_id").alias("fetched"), C(f"{l}.status").alias(l), C(f"{l}.generations").alias("extractions"), C(f"{l}.event_id").alias("extraction"), "measured")


@query(f"""WITH {CONTEXT}, w AS (SELECT DISTINCT l_orderkey AS walk, l_partkey AS id FROM lineitem)
SELECT walk, count(*) AS modules, count(f.id) AS verification, count(*) FILTER (coalesce(l.ok, false)) AS licence, least(count(f.id), count(*) FILTER (coalesce(l.ok, false))) = count(*) AS complete FROM w LEFT JOIN fac f ON f.id = w.id AND f.n = 1 LEFT JOIN lic l ON l.id = w.id AND l.n = 1 GROUP BY walk""")
def cmd_12_project_context(spark, sf_dir):
    nodes = t(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("walk"), C("l_partkey").alias("id"))
    return reports.project_context(_context(spark, sf_dir), nodes, ["id"], "walk", ["verification", "licence"])


@query(cte("mods", "licences") + f""", {SCANS_SQL}, nodes AS (SELECT path, version, max(size % 2 = 0) AS direct, min(id) AS id FROM mods WHERE size <> 50 GROUP BY path, version),
lic AS (SELECT * FROM (SELECT m.path, m.version, l.expression, row_number() OVER (PARTITION BY m.path, m.version ORDER BY m.price DESC, m.id) AS n FROM mods m JOIN licences l ON l.id = m.id WHERE m.id % 5 <> 0) WHERE n = 1),
fet AS (SELECT * FROM (SELECT path, version, CASE WHEN size % 3 = 0 THEN 'Verified' ELSE 'VerifiedByGoSum' END AS status, row_number() OVER (PARTITION BY path, version ORDER BY id DESC) AS n FROM mods WHERE id % 3 <> 1) WHERE n = 1),
vul AS (SELECT m.path, m.version, s.*, s.rooting LIKE 'target:%' AND s.rooting <> 'target:' || m.path || '@' || m.version AS consumer, s.rooting = 'isolated' AS isolated FROM scans s JOIN mods m ON m.id = s.id), va AS (SELECT *, max(consumer) OVER (PARTITION BY path, version) AS "any" FROM vul),
ser AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, version ORDER BY {RANKED}) AS n FROM va WHERE consumer OR NOT "any") WHERE n = 1), asi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, version ORDER BY {RANKED}) AS n FROM va WHERE isolated AND "any") WHERE n = 1),
top AS (SELECT path, version FROM (SELECT path, version, row_number() OVER (PARTITION BY path ORDER BY {o.key('version')} DESC NULLS LAST, version DESC) AS n FROM mods WHERE id % 40 <> 3) WHERE n = 1),
x AS (SELECT d.path, d.version, d.direct, coalesce(fet.status, '(not fetched)') AS verification, CASE WHEN d.path = 'example.com/m4' THEN CASE WHEN d.version = 'v1.4.1' THEN 'ISC' ELSE 'AGPL-3.0-only' END WHEN lic.path IS NULL THEN '(not run)' WHEN lic.expression = '' THEN '(unclassified)' ELSE lic.expression END AS licence,
  CASE WHEN d.path = 'example.com/m4' THEN 'override' WHEN lic.path IS NULL THEN 'none' ELSE 'record' END AS licence_source, coalesce(ser.findings, '(not run)') AS vulnerability, asi.findings AS declined, top.version AS latest
  FROM nodes d LEFT JOIN fet ON fet.path = d.path AND fet.version = d.version LEFT JOIN lic ON lic.path = d.path AND lic.version = d.version LEFT JOIN ser ON ser.path = d.path AND ser.version = d.version LEFT JOIN asi ON asi.path = d.path AND asi.version = d.version LEFT JOIN top ON top.path = d.path)
SELECT *, CASE WHEN latest IS NULL THEN NULL WHEN version = latest THEN 'level' WHEN NOT {o.valid('version')} OR NOT {o.valid('latest')} THEN 'behind' WHEN {o.key('version')} < {o.key('latest')} THEN 'behind' WHEN {o.key('version')} > {o.key('latest')} THEN 'ahead' ELSE 'level' END AS pin,
  vulnerability = 'Affected' OR licence IN ('AGPL-3.0-only', 'GPL-3.0-only', 'MIT OR GPL-3.0-only') AND licence <> 'MIT OR GPL-3.0-only' AS blocking FROM x""")
def cmd_01_audit_of_tables(spark, sf_dir):
    """The audit of all modules as one project's: generations of fetches, licences and scans, overrides, newest versions."""
    m = carrier(spark, sf_dir, "mods")
    nodes = m.select("path", "version", (C("size") == 50).alias("root"), (C("size") % 2 == 0).alias("direct"))
    fetches = m.where(C("id") % 3 != 1).select("path", "version", F.when(C("size") % 3 == 0, "Verified").otherwise("VerifiedByGoSum").alias("status"), "id")
    lic = m.where(C("id") % 5 != 0).join(carrier(spark, sf_dir, "licences").select("id", "expression"), "id").select("path", "version", "expression", "price", "id")
    vul = scans(spark, sf_dir).join(m.select("id", "path", "version"), "id")
    over = m.where("path = 'example.com/m4'").select("path", F.explode(F.array(F.struct(F.lit("").alias("version"), F.lit("AGPL-3.0-only").alias("spdx")), F.struct(F.lit("v1.4.1").alias("version"), F.lit("ISC").alias("spdx")))).alias("o")).select("path", "o.version", "o.spdx")
    rankings = {"fetch": [C("id").desc()], "licence": [C("price").desc(), C("id").asc()], "vulnerability": ranking()}
    return reports.audit(nodes, fetches, lic, vul, over, m.where(C("id") % 40 != 3).select("path", "version"), rankings, denied=["AGPL-3.0-only", "GPL-3.0-only"])


@query(f"""WITH {SCANS_SQL}, q AS (SELECT *, rooting LIKE 'target:%' AND rooting <> 'target:' || module || '@v1' AS consumer FROM scans), a AS (SELECT *, max(consumer) OVER (PARTITION BY module) AS "any" FROM q), f AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY {RANKED}) AS n FROM a WHERE consumer OR NOT "any")
SELECT module, CASE WHEN confidence > 100 THEN 'reachable' WHEN confidence > 20 THEN 'not reachable' ELSE 'not measured' END AS reach, CASE WHEN confidence <= 20 OR confidence > 100 THEN 'NotStated' WHEN completeness = 'BuiltWithBodies' THEN 'Confirmed' ELSE 'Unconfirmed' END AS soundness FROM f WHERE n = 1""")
def cmd_15_reachability(spark, sf_dir):
    g = frames.for_consumer(scans(spark, sf_dir), ["module"], "rooting", F.concat("module", F.lit("@v1")), ranking())
    r = F.when(C("confidence") > 20, C("confidence") > 100)
    rung = classify.negative_soundness(r, F.lit(False), F.lit("callgraph"), C("completeness"), F.lit(None).cast("boolean"), F.lit(False))
    return g.select("module", classify.reachability(r).alias("reach"), rung.alias("soundness"))


@query(f"""WITH s AS (SELECT CAST(floor(event_id / 4) AS BIGINT) AS run, CASE event_type WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Unscannable' WHEN 'purchase' THEN 'Affected' ELSE 'Clean' END AS status FROM events),
g AS (SELECT run, bool_and(status = 'Failed') AS f, bool_or(status IN ('Failed', 'Unscannable')) AS p, bool_or(status = 'Affected') AS a FROM s GROUP BY run) SELECT run, CASE WHEN f THEN 1 WHEN p THEN 5 WHEN a THEN 4 ELSE 0 END AS code FROM g""")
def cmd_24_exit_codes(spark, sf_dir):
    """The exit code of every scan run, by its status."""
    m = t(spark, sf_dir, "events").select(F.floor(C("event_id") / 4).alias("run"), F.when(C("event_type") == "error", "Failed").when(C("event_type") == "signup", "Unscannable").when(C("event_type") == "purchase", "Affected").otherwise("Clean").alias("status"))
    r = C("run_status")
    outcome = F.when(r == "ScanFailed", "error").when(r == "Partial", "partial").when(r == "Affected", "findings").otherwise("ok")
    return rollup.run_status(m, ["run"], "status").select("run", classify.exit_code(outcome).alias("code"))


@query("""WITH ln AS (SELECT l_orderkey AS run, l_partkey % 50 AS module, l_suppkey % 5 AS v, l_returnflag AS f, l_linenumber AS n FROM lineitem),
res AS (SELECT run, module, min(CASE f WHEN 'A' THEN 'Affected' WHEN 'R' THEN 'Failed' ELSE 'Clean' END) AS status FROM ln GROUP BY ALL),
fin AS (SELECT DISTINCT run, module, v FROM ln WHERE f = 'A'), rec AS (SELECT run, module, max(n <> 3) AS current FROM ln WHERE n <> 2 GROUP BY ALL),
r AS (SELECT o_custkey AS walk, o_orderkey AS run, o_orderdate AS at, o_orderpriority AS snapshot, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ordinal FROM orders),
st AS (SELECT run, count(*) AS total, count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (status = 'Affected') AS affected, count(*) FILTER (rec.run IS NULL) AS missing, count(*) FILTER (NOT current) AS superseded FROM res LEFT JOIN rec USING (run, module) GROUP BY run),
fr AS (SELECT walk, ordinal, module, v FROM fin JOIN r USING (run)), ms AS (SELECT walk, ordinal, module FROM res JOIN r USING (run) WHERE status <> 'Failed'),
nw AS (SELECT walk, ordinal, count(*) AS n FROM fr WHERE NOT EXISTS (SELECT 1 FROM fr p WHERE p.walk = fr.walk AND p.ordinal = fr.ordinal - 1 AND p.module = fr.module AND p.v = fr.v) GROUP BY ALL),
gn AS (SELECT fr.walk, fr.ordinal + 1 AS ordinal, count(*) AS n FROM fr JOIN ms ON ms.walk = fr.walk AND ms.ordinal = fr.ordinal + 1 AND ms.module = fr.module WHERE NOT EXISTS (SELECT 1 FROM fr p WHERE p.walk = fr.walk AND p.ordinal = fr.ordinal + 1 AND p.module = fr.module AND p.v = fr.v) GROUP BY ALL)
SELECT r.walk, r.run, r.ordinal, r.at, r.snapshot, CASE WHEN coalesce(failed, 0) = coalesce(total, 0) THEN 'ScanFailed' WHEN failed > 0 THEN 'Partial' WHEN affected > 0 THEN 'Affected' ELSE 'AllClean' END AS run_status, coalesce(total, 0) AS total, coalesce(failed, 0) AS failed, coalesce(failed, 0) AS gaps, coalesce(affected, 0) AS affected,
  coalesce(missing, 0) AS missing, coalesce(superseded, 0) AS superseded, coalesce(nw.n, 0) AS new, coalesce(gn.n, 0) AS resolved, r.walk % 10 <> 0 AS resolvable
FROM r LEFT JOIN st ON st.run = r.run LEFT JOIN nw ON nw.walk = r.walk AND nw.ordinal = r.ordinal LEFT JOIN gn ON gn.walk = r.walk AND gn.ordinal = r.ordinal""")
def cmd_14_scan_history(spark, sf_dir):
    """Orders as the scan runs of their customer, their lines as results, records and findings."""
    l = t(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("run"), (C("l_partkey") % 50).alias("module"), (C("l_suppkey") % 5).alias("finding"), "l_returnflag", C("l_linenumber").alias("n"))
    status = F.when(C("l_returnflag") == "A", "Affected").when(C("l_returnflag") == "R", "Failed").otherwise("Clean")
    results = dealt(l, ["run"], l.count()).groupBy("run", "module").agg(F.min(status).alias("status"))
    recs = l.where("n <> 2").select("run", "module", F.when(C("n") == 3, "p1").otherwise("p2").alias("pipeline"))
    runs = t(spark, sf_dir, "orders").select(C("o_custkey").alias("walk"), C("o_orderkey").alias("run"), C("o_orderdate").alias("at"), C("o_orderpriority").alias("snapshot"))
    walks = t(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(C("c_custkey").alias("walk"))
    return reports.scan_history(runs, results, recs, l.where("l_returnflag = 'A'"), walks, "p2")
