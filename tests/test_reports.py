"""Reports on small tables with what is missing, repeated and null."""

from pyspark.sql import functions as F

from depquarry.operators import reports

C = F.col


def test_verification_parts_the_total(spark):
    leg = "array<struct<kind:string,provenance:string>>"
    rows = [("a", "Verified", [("vcs", "rechecked")]), ("a", "Verified", [("sum", "rechecked"), ("vcs", "odd"), ("vcs", "inherited")]), ("a", "UnverifiedNoVCS", [("sum", "rechecked")]), ("a", "VerifiedByGoSum", None), ("a", "VerifiedBySumDBOnly", []), ("a", "LocalSource", None), ("a", None, [("vcs", "rechecked")]), ("a", "what", [("vcs", "absent")]), ("b", "VerifiedByGoSum", []), ("c", None, None), ("d", "LocalSource", [])]
    got = {r["k"]: r.asDict() for r in reports.verification_report(spark.createDataFrame(rows, f"k string, s string, l {leg}"), ["k"], "s", "l").collect()}
    a = got["a"]
    assert sum(a[c] for c in reports.CLASSES) == a["total"] == 8 and sum(a[f"vcs_{e}"] for e in reports.EVIDENCE) == a["cross_verifiable"] == 6
    assert (a["vcs_rechecked"], a["vcs_inherited"], a["vcs_never"], a["vcs_not_measured"], a["unrecognised"], a["unrecorded"]) == (1, 1, 2, 2, 1, 1)
    assert {k: r["collapsed"] for k, r in got.items()} == {"a": False, "b": True, "c": False, "d": False}


def test_closures_without_identifiers_and_without_conflicts(spark):
    schema = "walk int, path string, version string, spdx string, arms array<string>, measurement string, target string"
    rows = [
        (1, "b", "v1", "GPL-3.0", None, None, "MIT"), (1, "a", "v1", "", None, "unmeasured", "MIT"), (1, "c", "v1", None, ["MIT", "Odd"], None, "MIT"), (1, "d", "v1", None, ["Odd", "GPL-3.0-only"], None, "MIT"), (1, "e", "v1", None, ["GPL-3.0-only", "AGPL-3.0-only"], None, "MIT"),
        (1, "f", "v1", "AGPL-3.0-only", None, None, "MIT"), (1, "f", "v2", "OFL-1.1", None, None, "MIT"), (2, "a", "v1", "MIT", ["MIT"], None, "MIT"), (2, "b", "v1", None, ["ISC", "MIT"], None, "MIT"), (3, "a", "v1", "MIT", None, None, "Odd"),
    ]
    got = {r["walk"]: r for r in reports.closure_report(spark.createDataFrame(rows, schema), ["walk"]).collect()}
    assert [(c["path"], c["dep"], c["verdict"], c["kind"], c["electable"], c["measurement"]) for c in got[1]["conflicts"]] == [
        ("a", "", "unknown_pair", "unknown_pair", None, "unmeasured"), ("b", "GPL-3.0", "incompatible", "copyleft_propagation", None, "classified"), ("c", "MIT OR Odd", "electable", "election_required", ["MIT"], "classified"),
        ("d", "Odd OR GPL-3.0-only", "unknown_pair", "unknown_pair", None, "classified"), ("e", "GPL-3.0-only OR AGPL-3.0-only", "incompatible", "copyleft_propagation", None, "classified"),
        ("f", "AGPL-3.0-only", "incompatible", "network_trigger", None, "classified"), ("f", "OFL-1.1", "unknown_pair", "unknown_pair", None, "classified"),
    ]
    assert [(h["spdx"], h["modules"], h["deliberate"]) for h in got[1]["holes"]] == [("OFL-1.1", 1, True), ("Odd", 2, False)]
    assert (got[2]["clean"], got[2]["conflicts"], got[3]["clean"], got[3]["modelled"], got[1]["modelled"]) == (True, None, False, False, True)


def test_contexts_tell_not_run_from_superseded(spark):
    gens = spark.createDataFrame([("a", "v1", "ok", 1, "p2"), ("a", "v1", "bad", 2, "p2"), ("a", "v1", "new", 3, "p1"), ("b", "v1", "ok", 1, "p1")], "path string, version string, status string, at int, pipeline string")
    mods = spark.createDataFrame([("a", "v1"), ("b", "v1"), ("c", "v1"), ("a", "v1")], "path string, version string")
    key = ["path", "version"]
    out = reports.context(mods, key, {"x": (gens, [C("at").desc()]), "y": (gens.where("false"), [C("at").desc()])}, {"x": C("pipeline") == "p2"})
    got = {r["path"]: (r["x"]["status"], r["x"]["generations"], r["x"]["at"], r["y"]["status"], r["measured"]) for r in out.collect()}
    assert got == {"a": ("bad", 3, 2, "not_run", 1), "b": ("superseded", 1, None, "not_run", 0), "c": ("not_run", 0, None, "not_run", 0)}
    nodes = spark.createDataFrame([(1, "a", "v1"), (1, "a", "v1"), (2, "a", "v1"), (2, "z", "v1")], "walk int, path string, version string")
    whole = {r["walk"]: (r["modules"], r["x"], r["complete"]) for r in reports.project_context(out, nodes, key, "walk", ["x"]).collect()}
    assert whole == {1: (1, 1, True), 2: (2, 1, False)}


def test_an_audit_says_what_was_not_measured(spark):
    nodes = spark.createDataFrame([("root", "v0", True, False), ("a", "v1.0.0", False, True), ("a", "v1.0.0", None, False), ("b", "v1.0.0", False, False), ("c", "v2.0.0", False, True)], "path string, version string, root boolean, direct boolean")
    fetches = spark.createDataFrame([("a", "v1.0.0", "Verified", 2), ("a", "v1.0.0", "LocalSource", 1)], "path string, version string, status string, at int")
    lic = spark.createDataFrame([("a", "v1.0.0", "GPL-3.0-only OR MIT", 1), ("b", "v1.0.0", None, 1), ("c", "v2.0.0", "MIT", 1)], "path string, version string, expression string, at int")
    vul = spark.createDataFrame([("a", "v1.0.0", "Clean", "target:app@v1", 1), ("a", "v1.0.0", "Affected", "isolated", 9), ("c", "v2.0.0", "Affected", "", 1)], "path string, version string, findings string, rooting string, at int")
    over = spark.createDataFrame([("c", "", "MIT"), ("c", "v2.0.0", "GPL-3.0-only"), ("c", None, "ISC")], "path string, version string, spdx string")
    latest = spark.createDataFrame([("a", "v1.0.0"), ("a", "v1.10.0"), ("a", "v1.9.0"), ("b", "v0.9.0")], "path string, version string")
    by = [C("at").desc()]
    rank = {"fetch": by, "licence": by, "vulnerability": by}
    columns = ["verification", "licence", "licence_source", "vulnerability", "declined", "pin", "blocking"]
    got = {r["path"]: tuple(r[c] for c in columns) for r in reports.audit(nodes, fetches, lic, vul, over, latest, rank, denied=["GPL-3.0-only"]).collect()}
    assert got == {
        "a": ("Verified", "GPL-3.0-only OR MIT", "record", "Clean", "Affected", "behind", False), "b": ("(not fetched)", "(unclassified)", "record", "(not run)", None, "ahead", False),
        "c": ("(not fetched)", "GPL-3.0-only", "override", "Affected", None, None, True),
    }
    alone = reports.audit(nodes, fetches, lic, vul, over, latest, rank, rooting=F.lit("isolated")).where("path = 'a'").first()
    assert (alone["vulnerability"], alone["blocking"]) == ("Affected", True)


def test_history_resolves_only_what_was_measured(spark):
    runs = spark.createDataFrame([(1, "r1", 1, "s"), (1, "r2", 2, "s"), (1, "r3", 3, "s"), (2, "q", 1, "s")], "walk int, run string, at int, snapshot string")
    results = spark.createDataFrame([("r1", "m", "Affected"), ("r1", "n", "Affected"), ("r2", "m", "Clean"), ("r2", "n", "Failed"), ("r3", "n", "Affected")], "run string, module string, status string")
    found = spark.createDataFrame([("r1", "m", "V1"), ("r1", "n", "V2"), ("r1", "n", "V2"), ("r3", "n", "V3")], "run string, module string, finding string")
    records = spark.createDataFrame([("r1", "m", "p1"), ("r1", "n", "p2"), ("r1", "n", "p1")], "run string, module string, pipeline string")
    out = reports.scan_history(runs, results, records, found, spark.createDataFrame([(1,)], "walk int"), "p2")
    got = {r["run"]: (r["ordinal"], r["run_status"], r["missing"], r["superseded"], r["new"], r["resolved"], r["resolvable"]) for r in out.collect()}
    assert got == {"r1": (1, "Affected", 0, 1, 2, 0, True), "r2": (2, "Partial", 2, 0, 0, 1, True), "r3": (3, "Affected", 1, 0, 1, 0, True), "q": (1, "ScanFailed", 0, 0, 0, 0, False)}


def test_closure_report_reads_its_inputs_once(spark):
    rows = [("w", "p", "v1", "GPL-2.0", None, "x", "MIT"), ("w", "p", "v1", "Odd-1.0", None, "x", "MIT"), ("w", None, None, "Odd-1.0", None, "x", "MIT"), ("w", "p", "v1", "Odd-1.0", None, "y", "MIT"), ("u", "q", "v1", None, None, "unread", "MIT")]
    i = spark.createDataFrame(rows, "walk string, path string, version string, spdx string, arms array<string>, measurement string, target string")
    r = reports.closure_report(i, ["walk"])
    assert "Join" not in r._jdf.queryExecution().optimizedPlan().toString()
    got = {x["walk"]: x for x in r.collect()}
    assert [(h["spdx"], h["modules"]) for h in got["w"]["holes"]] == [("Odd-1.0", 2)] and len(got["w"]["conflicts"]) == 4
    assert got["u"]["holes"] is None and not got["u"]["clean"]


def test_tables_are_dealt_by_their_rows(spark, monkeypatch):
    from depquarry.plans import queries

    monkeypatch.setattr(queries, "TASK_ROWS", 100)
    assert queries.spread(spark.range(1001), "id").rdd.getNumPartitions() == 11
    assert queries.spread(spark.range(10), "id").rdd.getNumPartitions() == 4


def test_contexts_are_dealt_over_more_tasks_as_they_grow(spark, monkeypatch):
    from depquarry.operators import dealing

    monkeypatch.setattr(dealing, "TASK_ROWS", 10)
    mods = spark.range(100).select(F.col("id").alias("m"))
    gens = mods.where("m % 2 = 0").select("m", F.lit("ok").alias("status"), F.lit(1).alias("at"))
    out = reports.context(mods, ["m"], {"x": (gens, [F.col("at").desc()]), "y": (gens.where("m % 4 = 0"), [F.col("at").desc()])})
    nodes = spark.range(300).select((F.col("id") % 7).alias("walk"), (F.col("id") % 100).alias("m"))
    p = reports.project_context(out, nodes, ["m"], "walk", ["x", "y"])
    assert out.rdd.getNumPartitions() > 10 and p.rdd.getNumPartitions() > 10
    told = {(i % 7, i % 100) for i in range(300)}
    want = [(w, sum(a == w for a, _ in told), sum(a == w and m % 2 == 0 for a, m in told), sum(a == w and m % 4 == 0 for a, m in told), False) for w in range(7)]
    assert sorted(map(tuple, p.collect())) == want


def test_history_is_dealt_over_more_tasks_as_it_grows_and_holds_nulls_apart(spark, monkeypatch):
    from depquarry.operators import dealing

    monkeypatch.setattr(dealing, "TASK_ROWS", 2)
    runs = spark.createDataFrame([(1, f"r{i}", i, "s") for i in range(1, 31)], "walk int, run string, at int, snapshot string")
    results = spark.createDataFrame([("r1", None, "Affected"), ("r1", "m", "Affected"), ("r2", "m", "Clean"), ("r2", None, "Clean")], "run string, module string, status string")
    found = spark.createDataFrame([("r1", "m", None), ("r2", "m", None), ("r1", None, "V"), ("r2", None, "V"), ("r2", "m", "W")], "run string, module string, finding string")
    records = spark.createDataFrame([("r1", None, "p2"), ("r2", "m", "p1")], "run string, module string, pipeline string")
    out = reports.scan_history(runs, results, records, found, runs.select("walk"), "p2")
    assert out.rdd.getNumPartitions() > 10
    got = {r["run"]: (r["total"], r["missing"], r["superseded"], r["new"], r["resolved"]) for r in out.where("ordinal < 4").collect()}
    assert got == {"r1": (2, 2, 0, 2, 0), "r2": (2, 1, 1, 3, 1), "r3": (0, 0, 0, 0, 0)}
