"""Stored payloads, manifests, scanner output and Merkle proofs."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from depquarry.operators import merkle, rollup
from depquarry.plans.registry import QUERIES
from depquarry.sources import manifest, records, scanner

# ---- Merkle proofs -----------------------------------------------------------------------------------


def test_proofs_of_all_leaves_hold_and_altered_ones_fail(spark):
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 13, 31, 33, 70]
    rows = [(n, i, f"leaf {n}/{i}") for n in sizes for i in range(n)] + [(None, i, f"x{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "n long, i long, d string")
    got = merkle.proofs(df, ["n"], "i", F.col("d")).join(df.withColumnRenamed("n", "m"), "i").where("n <=> m")
    c = F.col
    right = merkle.proven(c("d"), c("index"), c("size"), c("siblings"), c("root"))
    wrong = {
        "leaf": merkle.proven(F.concat("d", F.lit("x")), c("index"), c("size"), c("siblings"), c("root")),
        "place": merkle.proven(c("d"), (c("index") + 1) % c("size"), c("size"), c("siblings"), c("root")),
        "beyond": merkle.proven(c("d"), c("size"), c("size"), c("siblings"), c("root")),
        "short": merkle.proven(c("d"), c("index"), c("size"), F.slice("siblings", F.lit(1), F.size("siblings") - 1), c("root")),
        "long": merkle.proven(c("d"), c("index"), c("size"), F.concat("siblings", F.array(F.unhex(F.lit("00" * 32)))), c("root")),
        "null": merkle.proven(c("d"), c("index"), c("size"), c("siblings"), F.lit(None).cast("string")),
    }
    out = got.select("n", "i", "size", "root", right.alias("right"), *[f.alias(k) for k, f in wrong.items() if k != "short"], F.when(F.size("siblings") > 0, wrong["short"]).otherwise(False).alias("short")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["right"] and not (r["leaf"] or r["beyond"] or r["short"] or r["long"] or r["null"])
        assert r["place"] == (r["size"] == 1)
    roots = {r["n"]: r["root"] for r in rollup.merkle_roots(df.where("n is not null"), ["n"], "i", F.col("d")).collect()}
    assert {r["n"]: r["root"] for r in out if r["n"]} == roots
    assert merkle.proofs(df.where("false"), ["n"], "i", F.col("d")).count() == 0


def test_proofs_are_those_of_trees_of_several_blocks_and_shuffle_a_leaf_few_times(spark):
    sizes = [255, 256, 257, 513, 700]
    rows = [(n, i, f"{n}/{i}") for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "n long, i long, d string")
    p = merkle.proofs(df, ["n"], "i", F.col("d"))
    got = p.join(df, ["n", "i"]).select("n", "i", "index", "size", "root", merkle.proven(F.col("d"), F.col("index"), F.col("size"), F.col("siblings"), F.col("root")).alias("right")).collect()
    assert len(got) == len(rows) and all(r["right"] and r["index"] == r["i"] and r["size"] == r["n"] for r in got)
    assert {r["n"]: r["root"] for r in got} == {r["n"]: r["root"] for r in rollup.merkle_roots(df, ["n"], "i", F.col("d")).collect()}
    # two rounds for these sizes, where one a level were ten
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 1


# ---- records -----------------------------------------------------------------------------------------


def test_a_stored_payload_is_compressed_and_hashed_once(spark, small):
    plan = QUERIES["src_05_decoded_records"](spark, small)._jdf.queryExecution()
    assert "decompressed(compressed(" not in plan.executedPlan().toString()
    assert not any("Filter" in l and "sha2(" in l for l in plan.optimizedPlan().toString().splitlines())


def stored(spark):
    recs = spark.createDataFrame([(i, f"mod{i}", i * 2) for i in range(8)] + [(8, "x" * 300_000, None)], "id long, name string, n long")
    edges = spark.createDataFrame([(i, f"a{j}", j % 3, None if j == 1 else "k") for i in range(6) for j in range(i)] + [(1, "a0", 0, "k")], "id long, src string, line int, kind string")
    return records.encode_records(recs, ["id"], ["name", "n"], edges, "id", ["src", "line"], 4)


def test_records_come_back_whole_or_with_their_reason(spark):
    blobs, edges = stored(spark)
    blobs, edges = blobs.cache(), edges.cache()
    read = lambda b, e: {r["id"]: r for r in records.decode_records(b, ["id"], "name string, n bigint", e, ["src", "line"], 4).collect()}
    ok = read(blobs, edges)
    assert all(r["reason"] is None for r in ok.values()) and ok[8]["record"]["name"] == "x" * 300_000 and ok[0]["edges"] == []
    assert [e["src"] for e in ok[5]["edges"]] == ["a0", "a1", "a2", "a3", "a4"] and [e["src"] for e in ok[1]["edges"]] == ["a0", "a0"]
    plain = records.decompressed("blob").cast("string")
    bad = blobs.select("id", F.when(F.col("id") == 0, F.lit(None).cast("binary")).when(F.col("id") == 1, F.substring("blob", 1, 30).cast("binary")).when(F.col("id") == 2, F.lit(b"no json")).when(F.col("id") == 3, F.regexp_replace(plain, '"schema_version":4', '"schema_version":3').cast("binary")).when(F.col("id") == 5, F.regexp_replace(plain, "mod5", "mod7").cast("binary")).when(F.col("id") == 7, plain.cast("binary")).otherwise(F.col("blob")).alias("blob"), F.when(F.col("id") == 4, "sha256:0").otherwise(F.col("stored_hash")).alias("stored_hash"))
    got = read(bad, edges)
    assert {i: r["reason"] for i, r in got.items()} == {0: "no payload", 1: "torn", 2: "unreadable", 3: "stale", 4: "hash differs", 5: "content differs", 6: None, 7: None, 8: None}
    assert got[5]["record"] is None and got[5]["edges"] is None
    lost = read(blobs, edges.where("src <> 'a4'"))
    assert {i for i, r in lost.items() if r["reason"] == "content differs"} == {5}


def test_no_records(spark):
    blobs, edges = stored(spark)
    assert records.decode_records(blobs.where("false"), ["id"], "name string, n bigint", edges, ["src", "line"], 4).count() == 0


# ---- manifests ---------------------------------------------------------------------------------------

TEXT = """// a comment
module example.com/a // the module
go 1.21
toolchain go1.21.3

require example.com/b v1.2.3 // indirect
require (
	example.com/c v0.0.1
	"example.com/d" v2.0.0+incompatible // indirect; kept

)
replace example.com/b => ../b
replace (
	example.com/c v0.0.1 => example.com/fork v1.0.0
	example.com/d => example.com/e v1.1.0
)
exclude example.com/z v0.1.0
retract [v1.0.0, v1.1.0] // broken
retract v1.5.0
tool example.com/t/cmd/x
require ()
"""


def parsed(spark, *texts):
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "m long, body string, line int")
    return [tuple(r) for r in manifest.parse(df, "m", "body").orderBy("id", "line").collect()]


def test_directives_of_a_manifest(spark):
    got = parsed(spark, TEXT)
    short = [r[1:9] for r in got]
    assert all(r[-1] is None for r in got)
    assert short == [
        (2, "module", "example.com/a", None, None, None, None, None), (3, "go", None, "1.21", None, None, None, None), (4, "toolchain", None, "go1.21.3", None, None, None, None),
        (6, "require", "example.com/b", "v1.2.3", None, None, True, None), (8, "require", "example.com/c", "v0.0.1", None, None, False, None), (9, "require", "example.com/d", "v2.0.0+incompatible", None, None, True, None),
        (12, "replace", "example.com/b", None, "../b", None, None, True), (14, "replace", "example.com/c", "v0.0.1", "example.com/fork", "v1.0.0", None, False), (15, "replace", "example.com/d", None, "example.com/e", "v1.1.0", None, False),
        (17, "exclude", "example.com/z", "v0.1.0", None, None, None, None), (18, "retract", None, "v1.0.0", None, "v1.1.0", None, None), (19, "retract", None, "v1.5.0", None, "v1.5.0", None, None), (20, "tool", "example.com/t/cmd/x", None, None, None, None, None),
    ]
    assert [r[9] for r in got if r[1] in (2, 18)] == ["the module", "broken"]


def test_faults_by_line(spark):
    bad = ["module a\nmodule b", "requires a v1", "require a", "require (\nb v1.0.0\nrequire (\nc v1.0.0\n)", "require (\na v1.0.0", ")", "exclude a 1.0.0", "replace a => b", "module (\na\n)", "go one", "retract [v1.0.0,x]", "replace a => b v1 => c", None, "", "  \n\t\n// x"]
    got = {(r[0], r[1]): r[10] for r in parsed(spark, *bad)}
    assert {k: v for k, v in got.items() if v} == {
        (0, 2): "repeated", (1, 1): "unknown directive", (2, 1): "malformed", (3, 1): "block not closed", (3, 3): "nested block", (4, 1): "block not closed", (5, 1): "no open block", (6, 1): "version is none",
        (7, 1): "replacement without version", (8, 1): "malformed", (9, 1): "malformed", (10, 1): "version is none", (11, 1): "malformed",
    }
    assert {k[0] for k in got} == set(range(12))


def test_long_lines_and_many_lines_of_a_manifest(spark):
    path = "example.com/" + "a" * 60_000
    lines = ["require (", *[f"\tb.org/x{i} v1.0.{i} // indirect" for i in range(3000)], f"\t{path} v1.0.0 // {'/c' * 60_000}", ")", "tool (", "a.org/t"]
    got = [r.asDict() for r in manifest.parse(spark.createDataFrame([("m", "\n".join(lines))], "m string, body string"), "m", "body").orderBy("line").collect()]
    assert len(got) == 3003 and sum(r["indirect"] or False for r in got) == 3000
    assert (got[3000]["path"], got[3000]["comment"]) == (path, "/c" * 60_000)
    assert [(r["line"], r["fault"]) for r in got if r["fault"]] == [(3004, "block not closed")]


def test_manifests_feed_version_selection(spark):
    from depquarry.operators import resolve

    texts = [(0, "module r\ngo 1.20\nrequire (\n a v1.0.0\n b v1.0.0\n)\nexclude c v9.0.0", "v0.0.0"), (1, "module a\ngo 1.20\nrequire c v1.1.0", "v1.0.0"), (2, "module b\ngo 1.16\nrequire c v1.2.0\nrequire a v1.0.0", "v1.0.0"), (3, "module c\ngo 1.20", "v1.2.0"), (4, "module a\nbroken", "v1.0.0")]
    df = spark.createDataFrame(texts, "m long, body string, version string")
    rows = manifest.faultless(manifest.parse(df, "m", "body"))
    req = manifest.requirements(rows, df.withColumnRenamed("m", "id"))
    nodes, _ = resolve.select_versions(req, ("r", "v0.0.0"))
    assert sorted((r["path"], r["version"]) for r in nodes.collect()) == [("a", "v1.0.0"), ("b", "v1.0.0"), ("c", "v1.2.0"), ("r", "v0.0.0")]


# ---- scanner output ----------------------------------------------------------------------------------


def frame(module, version="v1.0.0", function=None, receiver=None):
    return {k: v for k, v in dict(module=module, version=version, function=function, receiver=receiver).items() if v}


def finding(osv, *trace, fixed=None):
    return {"finding": {"osv": osv, "fixed_version": fixed, "trace": list(trace)}}


def scan(*messages, pretty=True):
    return "\n".join(json.dumps(m, indent=2 if pretty else None) for m in messages)


def messages(spark, scans):
    lines = [(k, i, x, 0) for k, text in scans.items() for i, x in enumerate(text.split("\n"))]
    df = spark.createDataFrame(lines, "scan string, no int, text string, seq int").drop("seq")
    return scanner.read_messages(scanner.framed(df, ["scan"], "no", "text"))


OSV = {"osv": {"id": "V1", "aliases": ["C1"], "summary": "bad", "affected": [{"package": {"name": "m"}, "ecosystem_specific": {"imports": [{"symbols": ["Z", "A"]}, {"symbols": ["A"]}]}}, {"package": {"name": "n"}, "ecosystem_specific": {}}]}}


def test_findings_by_module(spark):
    root = frame("root", function="main")
    scans = {
        "late": scan({"config": {"a": 1}}, finding("V1", frame("m")), finding("V1", frame("m", function="F", receiver="T"), root, fixed="v1.1.0"), finding("V1", frame("m", function="G"), root), finding("V1", frame("m", function="F", receiver="T"), root), OSV),
        "init": scan(OSV, finding("V1", frame("m", function="init"), frame("root", function="init#1")), pretty=False),
        "both": scan(OSV, finding("V1", frame("m")), finding("V1", frame("n"), fixed="v2.0.0"), finding("V2", frame("stdlib", "go1.2", "Do"), root), finding("V2", frame("stdlib", "go1.3")), finding("V3", frame("", "")), finding("V3", frame("x", "")), finding("", frame("m")), finding("V4")),
        "cut": scan(OSV, finding("V1", frame("m")))[:-20],
        "none": scan({"progress": {"message": "x"}}), "odd": "panic: x\n" + scan(OSV),
    }
    m = messages(spark, scans).cache()
    got = {(r["scan"], r["id"], r["module"], r["version"]): r for r in scanner.findings(m, ["scan"]).collect()}
    assert set(got) == {("late", "V1", "m", "v1.0.0"), ("init", "V1", "m", "v1.0.0"), ("both", "V1", "m", "v1.0.0"), ("both", "V1", "n", "v1.0.0"), ("both", "V2", "stdlib", "")}
    late = got["late", "V1", "m", "v1.0.0"]
    assert (late["reachable"], late["confidence"], late["symbols"], late["fixed_in"], late["summary"], late["aliases"]) == (True, "High", ["T.F", "G"], "v1.1.0", "bad", ["C1"])
    assert [[f["module"] for f in r] for r in late["routes"]] == [["root", "m"]] * 3
    init = got["init", "V1", "m", "v1.0.0"]
    assert (init["reachable"], init["confidence"], init["symbols"], init["routes"]) == (False, "Unknown", ["A", "Z"], [])
    both = got["both", "V1", "m", "v1.0.0"], got["both", "V1", "n", "v1.0.0"], got["both", "V2", "stdlib", ""]
    assert [(r["reachable"], r["confidence"], r["symbols"], r["names_no_symbols"]) for r in both] == [(False, "High", ["A", "Z"], False), (False, "High", [], True), (True, "High", ["Do"], False)]
    assert both[2]["summary"] is None
    verdicts = {r["scan"]: (r["messages"], r["advisories"], r["reports"], r["faults"]) for r in scanner.scan_verdicts(m, ["scan"]).collect()}
    assert verdicts == {"late": (6, 1, 4, 0), "init": (2, 1, 1, 0), "both": (9, 1, 8, 0), "cut": (2, 1, 0, 1), "none": (1, 0, 0, 0), "odd": (2, 1, 0, 1)}
    assert [r["id"] for r in scanner.of_module(scanner.findings(m, ["scan"]).where("scan = 'both'"), "n").orderBy("id").collect()] == ["V1", "V2"]


def test_the_same_findings_from_a_stream(spark, tmp_path):
    from depquarry.streaming import sinks

    rng = random.Random(2)
    parts = [scan(OSV, finding("V1", frame("m"))), scan(finding("V1", frame("m", function="F"), frame("root", function="main"), fixed="v9")), scan(finding("V2", frame("k", function="H")), {"osv": {"id": "V2", "summary": "late"}})]
    lines = [("a", i, x) for i, x in enumerate("\n".join(parts).split("\n"))] + [("b", i, x) for i, x in enumerate(parts[0].split("\n"))]
    m = scanner.framed(spark.createDataFrame(lines, "scan string, no int, text string"), ["scan"], "no", "text").collect()
    rng.shuffle(m)
    schema, table, keys = "scan string, seq long, raw string", f"{tmp_path}/table", ["scan", "id"]
    columns = None
    for i in range(3):  # started anew for each third
        spark.createDataFrame(m[i::3], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = scanner.settled(scanner.gathered(scanner.read_messages(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), ["scan"]), ["scan"])
        columns = columns or stream.schema

        def put(df, batch):
            sinks.replace_batch(df, df, keys, table, batch)

        sinks.run(stream, put, f"{tmp_path}/checkpoint", "update").awaitTermination()
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", gone boolean"
    got = sinks.latest(spark, table, ddl, keys)
    want = scanner.settled(scanner.gathered(scanner.read_messages(spark.createDataFrame(m, schema)), ["scan"]), ["scan"])
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and want.count() == 3


# ---- sinks -------------------------------------------------------------------------------------------


def test_replayed_batches_change_nothing_and_the_index_follows(spark, tmp_path):
    from depquarry.streaming import sinks

    schema = "module string, rooting string, findings array<string>, at int"
    records_, index = f"{tmp_path}/records", f"{tmp_path}/index"
    put = sinks.index_batch(records_, schema, index, ["module", "rooting"], lambda: F.struct("module", "rooting", "findings", "at"), lambda: [F.col("at").desc(), F.col("hash").asc()], F.col("findings"))
    rng = random.Random(7)
    given = [[(f"m{rng.randrange(5)}", rng.choice("ab"), rng.sample(["V1", "V2", "V3"], rng.randrange(4)), rng.randrange(9)) for _ in range(12)] for _ in range(4)]
    entries = lambda: sorted((r["module"], r["rooting"], r["finding_id"]) for r in sinks.latest(spark, index, "module string, rooting string, finding_id string, gone boolean", ["module", "rooting"]).collect())
    so_far = set()
    for b, rows in enumerate(given):
        df = spark.createDataFrame(rows, schema)
        put(df, b)
        so_far |= {(m, r, tuple(f), a) for m, r, f, a in rows}
        kept = sinks.committed(spark, records_, f"{schema}, hash string")
        assert sorted((r["module"], r["rooting"], tuple(r["findings"]), r["at"]) for r in kept.collect()) == sorted(so_far)
        hashes = {tuple(r)[:2] + (tuple(r["findings"]), r["at"]): r["hash"] for r in kept.collect()}
        want = []
        for frame_ in {x[:2] for x in so_far}:
            best = min((x for x in so_far if x[:2] == frame_), key=lambda x: (-x[3], hashes[x]))
            want += [(*frame_, f) for f in best[2]]
        assert entries() == sorted(want)
        before = (entries(), kept.count(), hashlib.md5(str(sorted(hashes.values())).encode()).hexdigest())
        put(df, b)  # replayed
        put(spark.createDataFrame(given[0], schema), 0)
        assert (entries(), sinks.committed(spark, records_, f"{schema}, hash string").count()) == before[:2]


def test_an_index_is_dealt_over_more_tasks_as_it_grows(spark, tmp_path, monkeypatch):
    from depquarry.operators import dealing
    from depquarry.streaming import sinks

    monkeypatch.setattr(dealing, "TASK_ROWS", 10)
    df = spark.range(200).select(F.concat(F.lit("m"), F.col("id") % 100).alias("module"), "id")
    ids = F.when(F.col("id") % 100 < 98, F.array(F.lit("V"), F.lit("V"), F.lit("C"))).when(F.col("id") % 100 == 98, F.array().cast("array<string>"))
    sinks.index_batch(f"{tmp_path}/r", "module string, id long", f"{tmp_path}/i", ["module"], lambda: F.struct("module", "id"), lambda: [F.col("id").desc()], ids)(df, 0)
    assert all(len(list((tmp_path / t / "batch=0").glob("*.parquet"))) > 10 for t in "ri")
    got = sinks.latest(spark, f"{tmp_path}/i", "module string, finding_id string, gone boolean", ["module"])
    assert got.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, got.collect())) == sorted((f"m{i}", v) for i in range(98) for v in "VC")
    # no ids and none at all both clear a frame
    assert sinks.committed(spark, f"{tmp_path}/i", "module string, finding_id string, gone boolean").where("gone and finding_id is null").count() == 2
