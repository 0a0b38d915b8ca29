"""Domain tables derived from the test tables, as SQL that Spark and DuckDB both read.

The test tables hold no dependency graph; these stand in for one: modules and versions, edges,
generations of records, advisories and snapshots, each over every row of its tables; the two snapshots
meet at one date.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages")

CARRIERS = {
    # versions of modules: releases, prereleases, +incompatible ones, and a few that are no version
    "mods": """SELECT CAST(p_partkey AS BIGINT) AS id, 'example.com/m' || CAST(p_partkey % 40 AS STRING) AS path,
        CASE WHEN p_size = 50 THEN 'latest' ELSE 'v' || CAST(p_size % 3 AS STRING) || '.' || CAST(p_partkey % 12 AS STRING) || '.' || CAST(p_size % 7 AS STRING) ||
        CASE WHEN p_size % 5 = 0 THEN '-rc.' || CAST(p_size % 13 AS STRING) WHEN p_size % 7 = 0 THEN '+incompatible' WHEN p_size % 11 = 0 THEN '-beta' ELSE '' END END AS version,
        p_brand AS brand, p_size AS size, p_retailprice AS price FROM {part}""",
    # who depends on whom, with cycles between nations and regions
    "deps": """SELECT 'o' || CAST(o_orderkey AS STRING) AS src, 'c' || CAST(o_custkey AS STRING) AS dst, 'Direct' AS confidence FROM {orders}
        UNION SELECT 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING), 'VTA' FROM {customer}
        UNION SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING), 'Framework' FROM {nation}
        UNION SELECT 'r' || CAST(n_regionkey AS STRING), 'n' || CAST(n_nationkey AS STRING), 'Unknown' FROM {nation}
        UNION SELECT 'o' || CAST(l_orderkey AS STRING), 'p' || CAST(l_partkey AS STRING), CASE l_returnflag WHEN 'A' THEN 'Direct' WHEN 'N' THEN 'VTA' ELSE 'CHA-overapprox' END FROM {lineitem}
        UNION SELECT 'p' || CAST(l_partkey AS STRING), 's' || CAST(l_suppkey AS STRING), CASE WHEN l_linenumber < 4 THEN 'VTA' ELSE 'CHA-overapprox' END FROM {lineitem}
        UNION SELECT 's' || CAST(s_suppkey AS STRING), 'n' || CAST(s_nationkey AS STRING), 'Direct' FROM {supplier}""",
    # generations of records of one key
    "gens": """SELECT event_id, user_id AS module, event_type AS source, ts AS taken, value AS confidence,
        CASE WHEN user_id % 5 = 0 THEN '' ELSE 'sha-' || CAST(user_id % 7 AS STRING) || CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'x' ELSE '' END END AS identity,
        CASE event_type WHEN 'error' THEN 'Affected' WHEN 'purchase' THEN 'Withdrawn' ELSE 'Clean' END AS findings,
        CASE WHEN value < 5 THEN 'Failed' WHEN value < 10 THEN 'Unscannable' ELSE 'Analysed' END AS coverage,
        CASE WHEN value > 100 THEN 'BuiltWithBodies' WHEN value > 50 THEN 'TypeOnly' WHEN value > 20 THEN 'MetadataOnly' ELSE 'Failed' END AS completeness FROM {events}""",
    # two snapshots of customers: their first and last order's state
    "snap_a": """SELECT o_custkey AS k, min(o_orderpriority) AS priority, min(o_orderstatus) AS status, count(*) AS n FROM {orders} WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY o_custkey""",
    "snap_b": """SELECT o_custkey AS k, min(o_orderpriority) AS priority, min(o_orderstatus) AS status, count(*) AS n FROM {orders} WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY o_custkey""",
    # advisories: each brand names modules, with up to two ranges; the last is open for some
    "advisories": """SELECT DISTINCT p_brand AS id, 'example.com/m' || CAST(p_partkey % 40 AS STRING) AS path FROM {part}""",
    "range_events": " UNION ".join(
        f"SELECT p_brand AS id, 'example.com/m' || CAST(p_partkey % 40 AS STRING) AS path, {n} AS position, '{kind}' AS kind, '{version}' AS version FROM {{part}} WHERE p_brand <> 'Brand#1'{more}"
        for n, kind, version, more in (
            (0, "introduced", "0", ""), (1, "fixed", "0.5.0", ""), (2, "introduced", "1.0.0-rc.4", ""), (3, "fixed", "1.7.2", ""), (4, "introduced", "v2.3.0", " AND p_brand <> 'Brand#2'"),
        )
    ),
    # licences of modules
    "licences": """SELECT p_partkey AS id, CASE p_size % 10 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'GPL-2.0' WHEN 3 THEN 'GPL-2.0-or-later' WHEN 4 THEN 'MPL-2.0' WHEN 5 THEN 'AGPL-3.0-only' WHEN 6 THEN 'MIT OR GPL-3.0-only' WHEN 7 THEN 'BSD-3-Clause AND MIT' WHEN 8 THEN 'CC-BY-4.0' ELSE '' END AS expression,
        CASE p_partkey % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL-3.0-only' WHEN 2 THEN 'Apache-2.0' ELSE 'AGPL-3.0-only' END AS target FROM {part}""",
}


def carrier(spark: SparkSession, sf_dir: str, name: str, distinct: bool = True) -> DataFrame:
    """The rows of a carrier; without ``distinct``, rows that unions state several times stay so, for readers to whom that is all one."""
    text = CARRIERS[name] if distinct else CARRIERS[name].replace(" UNION SELECT", " UNION ALL SELECT")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def cte(*names: str, recursive: bool = False) -> str:
    """The WITH clause of the carriers for DuckDB."""
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', CARRIERS[n])})" for n in names)
