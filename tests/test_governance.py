"""Governance, provenance, the ledger's report and paths from predecessors on small tables."""

import pytest
from pyspark.sql import functions as F

from depquarry.functions import classify, text
from depquarry.operators import governance, graph, provenance
from depquarry.sources import ledger

C = F.col


def outcomes(spark, rows, policies):
    df = spark.createDataFrame(rows, "area string, category string")
    return [r[0] for r in df.select(governance.outcome(C("area"), C("category"), policies)).collect()]


def test_outcomes_and_fallbacks(spark):
    rows = [("directive", "exclude_newer"), ("directive", "odd"), ("godebug", "red"), ("godebug", "unknown"), ("godebug", "amber"), ("vendor", "drift"), ("vendor", "odd"), ("fips", "deviation"), ("fips", "unknown"), ("fips", None), ("what", "red"), (None, None)]
    assert outcomes(spark, rows, {}) == ["allow", "allow", "allow", "warn", "allow", "allow", "warn", "allow", "allow", "allow", None, None]
    strict = {"directive": {"default": "warn", "exclude_newer": "notify"}, "godebug": {"red": "notify"}, "vendor": {"drift": "allow", "inconsistency": "notify"}, "fips": {"required": "yes"}}
    assert outcomes(spark, rows, strict) == ["notify", "warn", "notify", "notify", "allow", "allow", "notify", "warn", "warn", "warn", None, None]
    for bad in ({"what": {}}, {"vendor": {"red": "warn"}}, {"vendor": {"drift": "deny"}}):
        with pytest.raises(ValueError):
            governance.checked(bad)


def test_gates(spark):
    projects = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "k int")
    measured = spark.createDataFrame([(k, a) for k in (1, 2) for a in governance.AREAS] + [(3, "vendor"), (3, "vendor")], "k int, area string")
    found = spark.createDataFrame([(1, "godebug", "red"), (1, "godebug", "red"), (2, "godebug", "amber"), (3, "directive", None), (9, "vendor", "drift")], "k int, area string, category string")
    r = {x["k"]: x for x in governance.report(projects, measured, found, ["k"], {"godebug": {"red": "warn", "amber": "notify"}}).collect()}
    assert sorted(r) == [1, 2, 3, 4] and [r[k]["passes"] for k in (1, 2, 3, 4)] == [False, True, None, None]
    assert tuple(r[1]["godebug"]) == ("findings", 2, 0, 2) and tuple(r[2]["godebug"]) == ("findings", 1, 1, 0) and r[2]["vendor"]["status"] == "clean"
    assert (r[3]["vendor"]["status"], r[3]["directive"]["status"], r[3]["fips"]["status"], r[4]["vendor"]["status"]) == ("clean", "findings", "not_measured", "not_measured")


def test_directive_categories(spark):
    rows = [("replace", True, "", "v1"), ("replace", False, "x/f", "v1"), ("replace", False, "x/m", "v1"), ("exclude", False, "", "v1.0.0"), ("exclude", False, "", "v2.0.0"), ("exclude", False, "", "odd"), ("retract", False, "", "v1")]
    df = spark.createDataFrame(rows, "kind string, local boolean, new string, old string")
    got = [r[0] for r in df.select(governance.directive_category(C("kind"), C("local"), C("new"), F.lit("x/m"), C("old"), F.lit("v1.5.0"))).collect()]
    assert got == ["local_path_replace", "module_path_replace", "version_replace", "exclude_older", "exclude_newer", "exclude_newer", None]


LINES = "path string, version string, line int, holder string, verbatim string"


def test_provenance(spark):
    lines = [
        ("h/new/jwt-go", "v1.2.0", 1, "Dave Grijalva", "Copyright 2012 Dave Grijalva"), ("h/new/jwt-go", "v1.2.0", 2, "dave grijalva ", "Copyright 2013 dave grijalva"), ("h/new/jwt-go", "v1.2.0", 3, "<name of author>", "Copyright <name of author>"),
        ("h/new/jwt-go", "v1.10.0", 1, "A", "Copyright A"), ("h/new/jwt-go", "v1.10.0", 2, "B", "Copyright B"), ("h/one/x", "v1.0.0", 1, "  ", None), ("h/two/y", "v1.0.0", 1, None, None),
    ]
    records = [(p, v) for p, v, *_ in lines] + [("h/three/z", "v1.0.0")]
    related = [("h/new/jwt-go", "h/dgrijalva/jwt", False), ("h/new/jwt-go", "h/dgrijalva/other", False), ("h/new/jwt-go", "h/grijalva/odd", False), ("h/new/jwt-go", "h/grijalva/odd", True), ("h/new/jwt-go", "h/new/jwt-go/v2", True), ("h/new/jwt-go", "", True)]
    x, l, r = spark.createDataFrame(records, "path string, version string"), spark.createDataFrame(lines, LINES), spark.createDataFrame(related, "path string, other string, by_replace boolean")
    signs = {(i["version"], i["signal"], i["canonical"]): (i["holders"], i["evidence"]) for i in provenance.indicators(l, r, ["path", "version"]).collect()}
    dave = (["Dave Grijalva"], ["Copyright 2012 Dave Grijalva", "Copyright 2013 dave grijalva"])
    assert signs == {("v1.2.0", "holder_matches_path", "h/dgrijalva/jwt"): dave, ("v1.2.0", "holder_matches_path", "h/grijalva/odd"): dave, ("v1.10.0", "multiple_holders", None): (["A", "B"], ["Copyright A", "Copyright B"])}
    got = {i["path"]: i for i in provenance.report(x, l, r).collect()}
    j = got["h/new/jwt-go"]
    assert (j["version"], j["status"], j["candidates"], j["many_holders"], j["matched"], j["versions_disagree"]) == ("v1.10.0", "republication", 2, True, 0, False)
    assert [got[p]["status"] for p in ("h/one/x", "h/two/y", "h/three/z")] == ["none", "not_analysed", "not_analysed"]
    pins = spark.createDataFrame([("h/new/jwt-go", "v1.2.0"), ("h/new/jwt-go", "v9.0.0")], "path string, version string")
    assert {i["version"]: (i["status"], i["matched"]) for i in provenance.report(x, l, r, pins).collect()} == {"v1.2.0": ("republication", 2), "v9.0.0": ("not_analysed", 0)}
    assert provenance.report(x.limit(0), l.limit(0), r.limit(0)).count() == 0


def test_why_a_ledger_answers_nothing(spark):
    rows = [
        ("a", "e1", "2024-01-02 00:00:00", {"path": "m", "version": "v1"}, False, None, None), ("a", None, None, None, True, "2024-01-02 00:00:00", "2024-01-09 00:00:00"), ("a", "e2", "2024-01-09 00:00:00", {"path": "n"}, False, None, None),
        ("b", None, None, None, True, None, None), ("c", "e1", "2024-02-01 00:00:00", {"module": "m"}, False, None, None),
    ]
    df = spark.createDataFrame(rows, "k string, event string, ts string, payload map<string,string>, fault boolean, after string, before string")
    df = df.select("k", "event", C("ts").cast("timestamp"), "payload", "fault", C("after").cast("timestamp"), C("before").cast("timestamp"))

    def ask(**how):
        return {r["k"]: (r["matched"], r["unreadable_in_window"], r["zero_reasons"]) for r in ledger.report(df, ["k"], **how).collect()}

    assert ask() == {"a": (2, 1, []), "b": (0, 1, []), "c": (1, 0, [])}
    assert ask(since="2024-01-04 00:00:00", until="2024-01-05 00:00:00") == {"a": (0, 1, ["empty_window"]), "b": (0, 1, []), "c": (0, 0, ["outside_coverage"])}
    assert ask(since="2024-01-10 00:00:00")["a"] == (0, 0, ["outside_coverage"]) and ask(until="2024-01-01 00:00:00")["a"][1] == 0
    assert ask(module="m", version="v2") == {"a": (0, 1, ["other_version"]), "b": (0, 1, []), "c": (1, 0, [])}
    assert ask(module="q", event="e9")["a"][2] == ["unknown_module", "unknown_event"] and ask(module="m", event="e2")["a"][2] == ["together"]
    with pytest.raises(ValueError):
        ask(since="2024-01-02", until="2024-01-01")


def test_paths_back(spark):
    n = 300
    rows = [(i, i - 1 if i else None) for i in range(n)] + [(1000, 150), (1001, 1000), (2000, None), (3000, 9999)]
    preds = spark.createDataFrame(rows, "node long, pred long")
    targets = spark.createDataFrame([(299,), (299,), (1001,), (2000,), (0,), (3000,), (77777,)], "node long")
    got = {r["node"]: r["path"] for r in graph.paths_back(preds, targets).collect()}
    assert got == {299: list(range(300)), 1001: [*range(151), 1000, 1001], 2000: [2000], 0: [0]}
    with pytest.raises(ValueError):
        graph.paths_back(spark.createDataFrame([(1, 2), (2, 1)], "node long, pred long"), spark.createDataFrame([(1,)], "node long"))
    assert graph.paths_back(preds.limit(0), targets).count() == 0
    edges = spark.createDataFrame([("b", "d"), ("a", "b"), ("a", "c"), ("c", "d"), ("d", "a"), ("d", "e")], "src string, dst string")
    seen = graph.levels(edges, spark.createDataFrame([("a",)], "node string"))
    assert {r["node"]: r["pred"] for r in graph.predecessors(edges, seen).collect()} == {"a": None, "b": "a", "c": "a", "d": "b", "e": "d"}


def test_words_of_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(classify.completeness_caveat(F.lit("BuiltWithBodies"), "coding")) == ""
    assert get(classify.completeness_caveat(F.lit("TypeOnly"))) == "call graph is TypeOnly, not built with bodies — verdicts over this module may be incomplete"
    assert get(classify.attested(F.lit("a"), F.lit("v1"), F.lit(None).cast("string"), F.lit(None).cast("string")))["path"] == "a" and get(classify.attested(F.lit("a"), F.lit("v1"), F.lit("../b"), F.lit(""))) is None
    assert [get(text.bare_signature(F.lit(x))) for x in ("// a\n\t// b\nfunc F() // c\n", "//only", "\n// kept\nf", "/* b */ f", "")] == ["func F() // c", "", "// kept\nf", "/* b */ f", ""]
