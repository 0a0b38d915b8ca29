"""Queries for the operators that only the library's tests or other queries covered."""

from __future__ import annotations

from pyspark.sql import functions as F

from depquarry.functions import classify, semver, text
from depquarry.operators import diff, rollup
from depquarry.plans import oracle as o
from depquarry.plans.carriers import carrier, cte
from depquarry.plans.queries import query, t
from depquarry.sources import ledger, store

C = F.col


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_02_store_views(spark, sf_dir):
    tables = store.open_store(spark, sf_dir, ["region", "nation"])
    return tables["nation"].join(tables["region"], C("n_regionkey") == C("r_regionkey")).select("n_name", "r_name")


@query("SELECT DISTINCT l_partkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey = 7")
def src_06_edges_of_a_record(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    return store.generations(x, {"l_orderkey": 7}, ["l_linenumber", "l_partkey"], newest_first=False).select("l_partkey", "l_linenumber", "l_suppkey").distinct()


@query("SELECT p_partkey, p_size FROM part WHERE p_brand = 'Brand#3' AND p_size = 7")
def src_07_interface_generations(spark, sf_dir):
    return store.generations(t(spark, sf_dir, "part"), {"p_brand": "Brand#3", "p_size": 7}, ["p_partkey"]).select("p_partkey", "p_size")


@query(cte("licences") + " SELECT id, target FROM licences WHERE expression = 'MIT'")
def src_08_licence_generations(spark, sf_dir):
    return store.generations(carrier(spark, sf_dir, "licences"), {"expression": "MIT"}, ["id"]).select("id", "target")


@query("SELECT page_id, url FROM pages WHERE page_id = 11")
def src_09_example_generations(spark, sf_dir):
    return store.generations(t(spark, sf_dir, "pages"), {"page_id": 11}, ["page_id"]).select("page_id", "url")


@query(cte("gens") + " SELECT event_id, taken, findings FROM gens WHERE module = 8")
def src_10_vulnerability_generations(spark, sf_dir):
    return store.generations(carrier(spark, sf_dir, "gens"), {"module": 8}, ["taken", "event_id"], newest_first=False).select("event_id", "taken", "findings")


@query("SELECT event_id, event_type AS event, CAST(user_id AS STRING) AS who, event_id % 5 = 0 AS fault FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL, NULL, true FROM events WHERE event_id % 5 = 0")
def src_16_flat_ledger_lines(spark, sf_dir):
    line = F.concat(F.lit('{"event": "'), "event_type", F.lit('", "user": "'), C("user_id").cast("string"), F.when(C("event_id") % 5 == 0, "").otherwise('"}'))
    return ledger.decoded(t(spark, sf_dir, "events").select("event_id", line.alias("raw"))).select("event_id", "event", C("payload")["user"].alias("who"), "fault")


@query("""SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber > 3 AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_linenumber <= 3 AND x.l_partkey = lineitem.l_partkey AND x.l_suppkey = lineitem.l_suppkey)""")
def snk_02_hashed_append(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem")
    row = F.struct("l_partkey", "l_suppkey")
    pick = lambda cond: x.where(cond).select("l_partkey", "l_suppkey")
    return store.append_hashed(pick("l_linenumber <= 3"), pick("l_linenumber > 3"), row).drop("hash")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS known FROM customer")
def flt_08_existence_probe(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(C("o_custkey").alias("c_custkey"))
    return store.existing_of(t(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"])


API = "SELECT CASE WHEN p_partkey % 6 = 0 THEN 'm/testdata/x' ELSE 'm/p' || CAST(p_size AS STRING) END AS package, 'func' AS kind, 'F' || CAST(p_partkey AS STRING) AS name, {sig} AS signature FROM {part} WHERE {keep}"
OLD_API, NEW_API = {"sig": "p_brand", "keep": "p_partkey % 5 <> 0"}, {"sig": "CASE p_partkey % 4 WHEN 0 THEN p_brand || ' ' WHEN 1 THEN p_type ELSE p_brand END", "keep": "p_partkey % 7 <> 0"}


@query(f"""WITH a AS ({API.format(part="part", **OLD_API)}), b AS ({API.format(part="part", **NEW_API)}), j AS (SELECT coalesce(a.package, b.package) AS package, coalesce(a.name, b.name) AS name, a.signature AS x, b.signature AS y FROM a FULL JOIN b ON a.package = b.package AND a.name = b.name)
SELECT package, 'func' AS kind, name, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN regexp_replace(x, '\\s+', '', 'g') = regexp_replace(y, '\\s+', '', 'g') THEN 'spelling-only' ELSE 'changed' END AS change
FROM j WHERE package <> 'm/testdata/x' AND x IS DISTINCT FROM y""")
def flt_13_api_without_testdata(spark, sf_dir):
    side = lambda how: spark.sql(API.format(part="{part}", **how), part=t(spark, sf_dir, "part"))
    return diff.api_diff(side(OLD_API), side(NEW_API))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 40")
def srt_05_limit_and_offset(spark, sf_dir):
    return rollup.page(t(spark, sf_dir, "orders").select("o_orderkey"), [C("o_orderkey")], 25, 40)


@query("SELECT * FROM (SELECT s_suppkey, (SELECT count(*) FROM supplier) > 7 AS more FROM supplier ORDER BY s_suppkey LIMIT 7)")
def srt_06_truncation(spark, sf_dir):
    return rollup.first_rows(t(spark, sf_dir, "supplier").select("s_suppkey"), [C("s_suppkey")], 7)


@query(cte("mods") + f" SELECT id, {o.prefixed('version')} AS version, {o.prefixed('substr(version, 2)')} AS bare FROM mods")
def fn_11_v_prefixed(spark, sf_dir):
    return carrier(spark, sf_dir, "mods").select("id", semver.v_prefixed(C("version")).alias("version"), semver.v_prefixed(F.substring("version", 2, 100)).alias("bare"))


@query("SELECT event_id, ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 DAY AS fresh FROM events WHERE ts IS NOT NULL")
def fn_44_freshness_of_lookups(spark, sf_dir):
    return t(spark, sf_dir, "events").where("ts IS NOT NULL").select("event_id", text.is_fresh(C("ts"), F.lit("2024-01-20 00:00:00").cast("timestamp"), 5 * 86400).alias("fresh"))
