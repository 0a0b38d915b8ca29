import json

import pytest
from pyspark.sql import functions as F

from depquarry.functions import classify, licence, semver, text
from depquarry.operators import audit, diff, joins, rollup
from depquarry.sources import advisories, ledger
from depquarry.streaming import ledger_stream

ORDER = ["v0.0.0-20200101000000-abcdefabcdef", "v0.1.0", "v1.0.0-0", "v1.0.0-1", "v1.0.0-2", "v1.0.0-10", "v1.0.0-alpha", "v1.0.0-alpha.1", "v1.0.0-beta", "v1", "v1.2", "v1.10.0+incompatible", "v2.0.0", "v10.0.0"]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_semver_order(spark):
    df = spark.createDataFrame([(v,) for v in reversed([*ORDER, "1.0.0", "v01.0.0", "junk"])], "v string")
    got = [r["v"] for r in df.orderBy(semver.key(F.col("v")).asc_nulls_first(), "v").collect()]
    assert got[3:] == ORDER and set(got[:3]) == {"1.0.0", "v01.0.0", "junk"}


@pytest.mark.parametrize(("go", "want"), [("", True), ("1.16", True), ("1.16.5", True), ("1.17", False), ("1.21", False), ("1.24.0", False), ("garbage", True), (None, True)])
def test_before_pruning(spark, go, want):
    assert one(spark, semver.before_pruning(F.lit(go).cast("string"))) is want


@pytest.mark.parametrize(("path", "want"), [("x/jwt/v4", ("x/jwt", "/v", 4)), ("x/jwt", ("x/jwt", "/v", 0)), ("gopkg.in/yaml.v2", ("gopkg.in/yaml", ".v", 2)), ("example.com/proto.v2", ("example.com/proto.v2", "/v", 0)), ("x/mod/v1", ("x/mod/v1", "/v", 0))])
def test_module_family(spark, path, want):
    assert tuple(one(spark, text.family(F.lit(path)))) == want


@pytest.mark.parametrize(("dep", "target", "want"), [("MIT", "Apache-2.0", "compatible"), ("GPL-2.0-only", "Apache-2.0", "incompatible"), ("MPL-2.0", "Apache-2.0", "compatible"), ("GPL-2.0-or-later", "GPL-3.0-only", "compatible"), ("AGPL-3.0-only", "Apache-2.0", "incompatible"), ("odd", "MIT", "unknown_pair"), ("GPL-2.0", "MIT", "incompatible")])
def test_licence_pairs(spark, dep, target, want):
    assert one(spark, licence.compatibility(F.lit(dep), F.lit(target))) == want


def test_expressions(spark):
    assert one(spark, licence.arms(F.lit("MIT OR Apache-2.0 OR MIT"), "OR")) == ["Apache-2.0", "MIT"]
    assert one(spark, licence.arms(F.lit("MIT OR (A AND B)"), "OR")) is None
    assert one(spark, licence.arms(F.lit("GPL-2.0-only WITH x"), "OR")) is None
    assert one(spark, licence.derived_expression(F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.lit(True))) == "a OR b"


def test_open_intervals_and_branches(spark):
    e = spark.createDataFrame([("i", "p", n, k, v) for n, (k, v) in enumerate([("introduced", "0"), ("fixed", "1.25.13"), ("introduced", "1.26.0-0"), ("fixed", "1.26.6"), ("introduced", "1.27.0-0"), ("fixed", "1.27.0-rc.3")])], "id string, path string, position int, kind string, version string")
    r = joins.intervals(e, ["id", "path"])
    m = spark.createDataFrame([("p", v) for v in ("v1.25.12", "v1.25.13", "v1.26.0-rc.1", "v1.26.6", "v1.27.0-rc.2", "v1.27.0", "odd")] + [("q", "v1.0.0")], "path string, version string")
    bare = spark.createDataFrame([("i", "p"), ("j", "q")], "id string, path string")
    got = {(x["version"], x["id"], x["fix"]) for x in joins.affected(m, r, bare).collect()}
    assert got == {("v1.25.12", "i", "1.25.13"), ("v1.26.0-rc.1", "i", "1.26.6"), ("v1.27.0-rc.2", "i", "1.27.0-rc.3"), ("odd", "i", "1.25.13"), ("v1.0.0", "j", None)}


def test_longest_prefix_ends_at_separators(spark):
    items = spark.createDataFrame([("a/b/c",), ("a/bc",), ("a",), ("z",), ("",)], "item string")
    p = spark.createDataFrame([("a",), ("a/b",)], "p string")
    assert {r["item"]: r["p"] for r in joins.longest_prefix(items, "item", p, "p").collect()} == {"a/b/c": "a/b", "a/bc": "a", "a": "a", "z": None, "": None}


def test_verdicts_stay_open_where_something_is_unmeasured(spark):
    no, yes = F.lit(False), F.lit(True)
    assert one(spark, classify.negative_verdict(classify.sinks(F.lit("n"), no, no, no, no, yes, yes, no))) == "RESOLVED-ABSENT"
    assert one(spark, classify.negative_verdict(classify.sinks(F.lit("n"), no, no, no, no, no, yes, no))) == "UNRESOLVED"
    assert one(spark, classify.reachability(F.lit(None).cast("boolean"))) == "not measured"


def test_ledger_faults_are_kept_and_bounded(spark, tmp_path):
    lines = ['{"event":"fetch","ts":"2024-01-01T00:00:00Z","path":"a","version":"v1"}', "{oops", '{"event":"scan","ts":"2024-01-02T00:00:00Z","payload":{"module":"a"}}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    got = ledger.read_ledger(spark, str(tmp_path / "log.jsonl")).orderBy("line")
    rows = got.collect()
    assert [r["fault"] for r in rows] == [False, True, False]
    assert str(rows[1]["after"]) == "2024-01-01 00:00:00" and str(rows[1]["before"]) == "2024-01-02 00:00:00"
    assert rows[0]["payload"] == {"path": "a", "version": "v1"} and rows[2]["payload"] == {"module": "a"}
    assert got.where(ledger.matches(module="a", version="v2")).count() == 1


def test_ledger_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"event":"scan","ts":"2024-01-02T00:10:00Z"}\n{"event":"scan","ts":"2024-01-02T00:20:00Z"}\n{oops\n')
    run = lambda: ledger_stream.run_to_table(ledger_stream.event_counts(ledger_stream.stream_ledger(spark, str(tmp_path / "in"))), str(tmp_path / "counts"), str(tmp_path / "ck")).awaitTermination(60)
    run()
    assert [(r["event"], r["n"]) for r in ledger_stream.counted(spark, str(tmp_path / "counts")).collect()] == [("scan", 2)]
    (tmp_path / "in" / "b.jsonl").write_text('{"event":"scan","ts":"2024-01-02T00:30:00Z"}\n{"event":"walk","ts":"2024-01-02T01:30:00Z"}\n')
    run()
    assert sorted((r["event"], r["n"]) for r in ledger_stream.counted(spark, str(tmp_path / "counts")).collect()) == [("scan", 3), ("walk", 1)]


def test_advisories(spark, tmp_path):
    doc = {"id": "A-1", "affected": [{"package": {"name": "p", "ecosystem": "Go"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.2.0"}]}, {"type": "GIT", "events": [{"introduced": "abc"}]}], "ecosystem_specific": {"imports": [{"path": "p/x", "symbols": ["B", "A"]}]}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    a = advisories.read_advisories(spark, str(tmp_path))
    assert [(r["kind"], r["version"]) for r in advisories.range_events(a).orderBy("position").collect()] == [("introduced", "0"), ("fixed", "1.2.0")]
    assert advisories.named(a).first()["symbols"] == ["A", "B"]


def test_truncation(spark):
    rows, more = rollup.truncated(spark.range(5), [F.col("id")], 3)
    assert [r["id"] for r in rows.collect()] == [0, 1, 2] and more
    assert not rollup.truncated(spark.range(3), [F.col("id")], 3)[1]


@pytest.mark.parametrize(
    ("message", "want"),
    [
        ("a@v1.0.0 requires\n\tx/y@v1.2.3: module lookup disabled by GOPROXY=off", ("x/y", "v1.2.3")),
        ("stdr.go:25:2: module lookup disabled by GOPROXY=off", None),
        ("/tmp/cache/x@v1.2.1/f.go:3:4: module lookup disabled by GOPROXY=off", None),
        ("x/y@latest: module lookup disabled by GOPROXY=off", None),
        ("x/y@v1.2.3: not found", None),
        ("", None),
        (None, None),
    ],
)
def test_unresolved_coordinate(spark, message, want):
    got = one(spark, classify.unresolved_coordinate(F.lit(message).cast("string")))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("package", "receiver", "symbol", "want"), [("os", "", "Getenv", "READ_SYSTEM_STATE"), ("os", "*File", "Chdir", "MODIFY_SYSTEM_STATE"), ("os", "*File", "Read", "FILES"), ("os/exec", None, "Command", "EXEC"), ("os/execute", "", "Command", None), (None, "", "F", None)])
def test_capability(spark, package, receiver, symbol, want):
    assert one(spark, classify.capability(*[F.lit(x).cast("string") for x in (package, receiver, symbol)])) == want


@pytest.mark.parametrize(("raw", "go", "mode", "want"), [("go1.22 X:boringcrypto", "1.22", "", "boringcrypto"), ("go1.24.0", "1.24", "on", "go-fips140"), ("go1.24.0", "1.24", "off", ""), ("go1.23", "1.23.9", "on", ""), ("", None, None, ""), ("", "junk", "on", "")])
def test_fips_variant(spark, raw, go, mode, want):
    assert one(spark, classify.fips_variant(F.lit(raw), F.lit(go).cast("string"), F.lit(mode).cast("string"))) == want


def test_build_failures(spark):
    assert one(spark, classify.is_build_failure(F.lit("x: Build constraints exclude all Go files in y"))) is True
    assert one(spark, classify.is_build_failure(F.lit(None).cast("string"))) is False
    assert one(spark, classify.is_non_fips_package(F.lit("crypto/md5/internal"))) is False


def test_audit_rows_tell_null_values_from_no_record(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, path string")
    facts = {"licence": (spark.createDataFrame([("a", None)], "path string, spdx string"), ["path"]), "none": (spark.createDataFrame([], "id int, x int"), ["id"])}
    got = {r["id"]: (r["spdx"], r["licence_recorded"], r["none_recorded"]) for r in audit.audit_rows(nodes, facts).collect()}
    assert got == {1: (None, True, False), 2: (None, False, False), 3: (None, False, False)}


def test_narrowing(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (None, "2024-01-03")], "k int, d string").withColumn("d", F.to_date("d"))
    ids = lambda x: sorted((r["k"] or 0) for r in x.collect())
    assert ids(audit.narrowed(df)) == [0, 1, 2]
    assert ids(audit.narrowed(df, at="d", since="2024-01-02", until="2024-01-03")) == [0, 2]
    none = df.where("k > 9")
    assert ids(audit.members(df, None, ["k"])) == [0, 1, 2] and ids(audit.members(df, none, ["k"])) == []
    assert ids(audit.beyond(df, df.where("k = 1"), ["k"])) == [0, 2]
    edges = spark.createDataFrame([(1, True), (2, None), (3, False)], "k int, t boolean")
    assert ids(audit.edges_asked(edges, F.col("t"))) == [2, 3] and ids(audit.edges_asked(edges, F.col("t"), False)) == [1, 2, 3]


def test_directive_diff(spark):
    of = lambda *rows: spark.createDataFrame(rows, "path string, line string, risk string")
    old = of(("a", "1", "low"), ("b", None, "low"), ("c", "1", "high"), ("c", "1", "high"))
    new = of(("a", "1", "high"), ("c", "1", "high"), ("d", "", None))
    got = {tuple(r) for r in diff.directive_diff(old, new, ["path", "line"], "risk").collect()}
    assert got == {("a|1", "reclassified", "low", "high"), ("b|", "removed", "low", None), ("d|", "added", None, None)}
    assert one(spark, diff.merged(F.lit(None).cast("array<int>"), F.array(F.lit(2), F.lit(1)))) == [1, 2]


def test_build_list_ends(spark):
    modules = spark.createDataFrame([("t", None, True, None, None), ("a", "v1", False, "f/a", "v2"), ("b", "v1", False, "../b", None)], "path string, version string, main boolean, replace_path string, replace_version string")
    edges = spark.createDataFrame([("t", "a", "v1"), ("t", "a", "v0"), ("a", "b", "v1"), ("a", "z", "v3"), ("go", "a", "v1"), ("t", "toolchain", "v1")], "src string, dst string, asked string")
    nodes, ends = audit.from_build_list(modules, edges)
    assert {tuple(r) for r in nodes.collect()} == {("f/a", "v2", "proxy"), ("b", "v1", "local_replace")}
    assert {tuple(r) for r in ends.collect()} == {("t", None, "f/a", "v2", "v0"), ("f/a", "v2", "b", "v1", "v1"), ("f/a", "v2", "z", "v3", "v3")}


def test_freshness_counts_parts_of_a_second(spark, tmp_path):
    from compare import rows_of
    from depquarry.plans.registry import ORACLES, QUERIES

    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    for at, want in (("2024-01-15 00:00:00", False), ("2024-01-15 00:00:00.000001", True), ("2024-01-14 23:59:59.999999", False), (None, False)):
        assert one(spark, text.is_fresh(F.lit(at).cast("timestamp"), now, 5 * 86400)) is want
    # at and around the boundary of both queries, against their SQL
    for i, day in enumerate(("2024-01-15", "2024-01-21")):
        at = [f"timestamp_ntz '{day} 00:00:00' + interval '{n}' second" for n in ("-1", "-0.5", "-0.000001", "0", "0.000001", "0.5", "1")]
        rows = " union all ".join(f"select {i * 10 + k} as event_id, {x} as ts" for k, x in enumerate(at))
        spark.sql(rows).coalesce(1).write.parquet(f"{tmp_path}/{i}/events.parquet")
        part = next((tmp_path / str(i) / "events.parquet").glob("*.parquet"))
        (tmp_path / f"sf{i}").mkdir()
        part.rename(tmp_path / f"sf{i}" / "events.parquet")
        for name in ("fn_44_freshness_of_lookups", "flt_18_freshness"):
            assert rows_of(QUERIES[name](spark, str(tmp_path / f"sf{i}"))) == events_rows(ORACLES[name], tmp_path / f"sf{i}")


def events_rows(sql, folder):
    import duckdb
    from compare import plain

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    r = con.sql(sql)
    at = [r.columns.index(c) for c in sorted(r.columns)]
    return sorted(r.columns), sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)


def test_pages_are_cut_from_ranges(spark, monkeypatch):
    monkeypatch.setattr(rollup, "PAGE_ROWS", 5, raising=False)
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("id"))
    for limit, offset in ((0, 50), (0, 99), (0, 200), (7, 3), (40, 33), (3, 98), (1, 0)):
        want = list(range(99, -1, -1))[offset : offset + limit if limit else None]
        p = rollup.page(df, [F.col("id").desc()], limit, offset)
        assert [r["id"] for r in p.collect()] == want
        assert "Offset" not in p._jdf.queryExecution().optimizedPlan().toString()
