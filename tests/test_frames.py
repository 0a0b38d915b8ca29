"""Frames of analysis, staleness and sealed records against plain versions."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from depquarry.operators import compose, frames, seal, staleness

RECORD = "module string, rooting string, findings string, coverage string, completeness string, snapshot_at int, snapshot string, at int, hash string"
C = F.col


def ranking():
    return compose.vulnerability_ranking(C("findings"), C("coverage"), compose.rank_of(C("completeness"), compose.COMPLETENESS), C("snapshot_at"), C("snapshot"), C("at"), C("hash"))


def best(rows):
    rung = lambda r: compose.COMPLETENESS.index(r[4]) if r[4] in compose.COMPLETENESS else -1
    return min(rows, key=lambda r: (r[2] not in ("Affected", "Withdrawn"), r[3] != "Analysed", -rung(r), -r[5], [-ord(c) for c in r[6]], -r[7], r[8])) if rows else None


@pytest.fixture(scope="module")
def generations():
    rng = random.Random(1)
    rootings = ["isolated", "target:m1@v1", "target:m1@v2", "target:app@v0", "target:lib@v3", "", None]
    rows = []
    for m in range(1, 25):
        mine = rng.sample(rootings, rng.randrange(1, 7)) if m % 4 else ["", None]
        for i in range(rng.randrange(1, 14)):  # few values, so that many rungs tie
            rows.append((f"m{m}", rng.choice(mine), rng.choice(["Affected", "Withdrawn", "Clean"]), rng.choice(["Analysed", "Failed"]), rng.choice(["BuiltWithBodies", "Failed", "odd"]), rng.randrange(2), rng.choice("ab"), rng.randrange(2), f"h{m}-{i:02}"))
    return rows


def by_module(rows):
    return {k: list(g) for k, g in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0])}


def test_frames_are_picked_before_the_ranking(spark, generations):
    df = spark.createDataFrame(generations, RECORD)
    plain = lambda f: {m: x for m, rows in by_module(generations).items() if (x := f(rows))}
    got = lambda d: {r["module"]: tuple(r)[:9] for r in d.select(*df.columns).collect()}
    at = lambda rows: best([r for r in rows if r[1] == "target:app@v0"] or ([] if any(r[1] for r in rows) else rows))
    assert got(frames.at_rooting(df, ["module"], "rooting", F.lit("target:app@v0"), ranking())) == plain(at)
    tree = lambda rows: best([r for r in rows if (r[1] or "").startswith("target:m1@")] or [r for r in rows if r[1] == "isolated"] or ([] if any(r[1] for r in rows) else rows))
    assert got(frames.for_tree(df, ["module"], "rooting", F.lit("m1"), ranking())) == plain(tree)
    own = F.concat("module", F.lit("@v1"))
    consumer = {m: [r for r in rows if (r[1] or "").startswith("target:") and r[1] != f"target:{m}@v1"] for m, rows in by_module(generations).items()}
    served = frames.for_consumer(df, ["module"], "rooting", own, ranking())
    assert got(served) == {m: best(consumer[m] or rows) for m, rows in by_module(generations).items()}
    asides = {r["module"]: r["aside"] and tuple(r["aside"]) for r in served.collect()}
    assert asides == {m: best([r for r in rows if r[1] == "isolated"]) if consumer[m] else None for m, rows in by_module(generations).items()}
    assert any(asides.values()) and frames.for_consumer(df.where("false"), ["module"], "rooting", own, ranking()).count() == 0


def test_all_rungs_decide_in_turn(spark):
    top = ("m", "isolated", "Affected", "Analysed", "BuiltWithBodies", 9, "z", 9, "a")
    lower = [("Clean", 2), ("Failed", 3), ("TypeOnly", 4), (8, 5), ("y", 6), (8, 7), ("b", 8)]
    rows = [top] + [tuple(v if j == i else x for j, x in enumerate(top)) for v, i in lower]
    for n in range(len(rows), 0, -1):
        df = spark.createDataFrame(rows[-n:][::-1], RECORD)
        got = frames.at_rooting(df, ["module"], "rooting", F.lit("isolated"), ranking()).first()
        assert tuple(got)[:9] == best(rows[-n:])


def test_rooting_is_stamped_and_routes_start_somewhere(spark):
    answer = "struct<ok:boolean,rooting:string>"
    df = spark.createDataFrame([("isolated", [("V1", (True, "")), ("V2", (False, "target:a@v1")), ("V3", None), ("V4", (True, None))]), ("target:x@v1", [])], f"rooting string, findings array<struct<id:string,reachable:{answer}>>")
    got = [r["f"] for r in df.select(frames.with_rooting(C("findings"), "reachable", C("rooting")).alias("f")).collect()]
    assert [(f["id"], f["reachable"] and f["reachable"]["rooting"]) for f in got[0]] == [("V1", "isolated"), ("V2", "target:a@v1"), ("V3", None), ("V4", "isolated")] and got[1] == []
    rows = [("target:a@v1", "a", "v9", "a", "v8"), ("target:b@v1", "a", "v9", "a", "v8"), ("target:b@v1", "a", "", "a", "v8"), ("isolated", "a", None, "b", "v8"), (None, "a", "v1", None, None), ("target:a@v1", "", "v1", "", "v1"), ("target:a@v1", None, "v1", "a", "v1")]
    r = spark.createDataFrame(rows, "r string, fp string, fv string, rp string, rv string")
    assert [x[0] for x in r.select(frames.route_start(C("r"), C("fp"), C("fv"), C("rp"), C("rv"))).collect()] == ["a@v1", "a@v9", "a@v8", None, "a@v1", None, None]


def test_rescan_reuses_refuses_and_scans(spark):
    walks = spark.createDataFrame([("pub", False, None), ("dir", True, "/here"), ("gone", True, "/gone"), ("bare", True, ""), ("lost", True, None), ("new", True, None)], "walk string, local boolean, project_dir string")
    modules = spark.createDataFrame([(w, m) for w in ("pub", "dir", "gone", "bare", "lost", "new") for m in ("a", "b", "a")], "walk string, module string")
    runs = spark.createDataFrame([("dir", "d1", 1), ("dir", "d2", 2), ("bare", "b1", 3), ("bare", "b0", 2), ("lost", "l1", 1), ("pub", "p1", 1), ("gone", "g1", 1)], "walk string, run string, at int")
    rows = [("d2", "a", "target:x@v0", "s2", "complete", 1), ("d2", "b", "target:x@v0", "s1", "complete", 1), ("d2", "b", "isolated", "s2", "complete", 2), ("d1", "b", "target:x@v0", "s2", "complete", 9), ("b1", "a", "isolated", "s2", "failed", 1), ("b1", "b", "isolated", "s2", "complete", 1), ("b0", "a", "target:x@v0", "s2", "complete", 1), ("l1", "a", "target:x@v0", "s2", "complete", 1), ("p1", "a", "isolated", "s2", "complete", 1), ("p1", "a", "isolated", "s1", "complete", 5)]
    records = spark.createDataFrame(rows, "run string, module string, rooting string, snapshot string, status string, n int")
    here = spark.createDataFrame([("/here",)], "project_dir string")
    act = lambda force: {(r["walk"], r["module"]): (r["action"], r["root"]) for r in frames.rescan(walks, modules, runs, records, here, "s2", [C("n").desc()], force).collect()}
    always = act(True)
    assert always == {(w, m): x for m in "ab" for w, x in {"pub": ("rescan", None), "dir": ("rescan", "/here"), "gone": ("refuse", None), "bare": ("rescan", None), "lost": ("refuse", None), "new": ("rescan", None)}.items()}
    assert {k: v for k, v in act(False).items() if v != always[k]} == {("dir", "a"): ("reuse", "/here"), ("bare", "b"): ("reuse", None)}


def test_staleness_by_legs(spark):
    now = dt.datetime(2024, 5, 1, 12)
    ago = lambda h: now - dt.timedelta(hours=h)
    asked = [("a", "v1.0.0"), ("b", "v2.1.0+incompatible"), ("b", "v1.0.0"), ("c/v2", "v2.0.0"), ("d", None), ("e", "v1.0.0"), ("f", "v1.0.0"), ("g", "v3.0.0+incompatible"), ("gopkg.in/y.v2", "v2.0.0"), ("h", "v1.0.0")]
    ledger = [
        ("a", "v1.4.0", ago(50), ago(1), True, 2, 4, "v4.0.0", False, None), ("b", "v2.1.0+incompatible", ago(60), ago(2), True, 3, None, None, True, "v2.2.0"), ("c/v2", "v2.3.0", ago(60), ago(99), True, 3, None, None, False, None),
        ("f", "v1.1.0", ago(60), ago(1), False, 2, None, None, False, None), ("g", "v3.0.0+incompatible", ago(60), ago(1), True, 4, None, None, False, None), ("h", "v1.0.0", ago(9), ago(1), False, 2, None, None, False, None),
    ]
    latest = [("c/v2", "v2.5.0", ago(3)), ("d", "v1.9.0", ago(4)), ("gopkg.in/y.v2", "v2.0.1", ago(5)), ("a", "v7.0.0", ago(0))]
    published = [("b", 2, "v2.2.1"), ("b", 3, "v3.0.0"), ("c", 3, "v3.1.0"), ("c", 4, "v4.1.0"), ("c", 6, "v6.0.0"), ("f", 2, "v2.0.0"), ("f", 3, None), ("g", 3, "v3.3.5"), ("g", 5, "v5.0.0"), ("gopkg.in/y", 3, "v3.0.1"), ("a", 2, "v2.0.0")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = (
        frame(asked, "path string, pinned string"), frame(ledger, "path string, latest string, latest_at timestamp, looked_up_at timestamp, probed boolean, from_major long, newer_major long, newer_version string, asked_again boolean, again_version string"),
        frame(latest, "path string, version string, at timestamp"), frame(published, "stem string, major long, version string"), F.lit(now),
    )
    answers, writes = staleness.resolve(*tables, 6 * 3600)
    got = {(r["path"], r["pinned"]): (r["source"], r["latest"], r["probed"], r["from_major"], r["newer_major"], r["newer_version"], r["asked_again"], r["again_version"], r["error"]) for r in answers.collect()}
    assert got == {
        ("a", "v1.0.0"): ("ledger", "v1.4.0", True, 2, 4, "v4.0.0", False, None, None), ("b", "v2.1.0+incompatible"): ("ledger", "v2.1.0+incompatible", True, 3, None, None, True, "v2.2.0", None),
        ("b", "v1.0.0"): ("mixed", "v2.1.0+incompatible", True, 2, 3, "v3.0.0", False, None, None), ("c/v2", "v2.0.0"): ("live", "v2.5.0", True, 3, 4, "v4.1.0", False, None, None), ("d", None): ("live", "v1.9.0", True, 2, None, None, False, None, None),
        ("e", "v1.0.0"): ("live", None, None, None, None, None, None, None, "lookup failed"), ("f", "v1.0.0"): ("mixed", "v1.1.0", False, 2, None, None, False, None, None), ("g", "v3.0.0+incompatible"): ("mixed", "v3.0.0+incompatible", True, 4, None, None, True, "v3.3.5", None),
        ("gopkg.in/y.v2", "v2.0.0"): ("live", "v2.0.1", True, 3, 3, "v3.0.1", False, None, None), ("h", "v1.0.0"): ("mixed", "v1.0.0", True, 2, None, None, False, None, None),
    }
    kept = {r["path"]: r["looked_up_at"] for r in writes.collect()}
    assert kept == {"b": ago(2), "c/v2": now, "d": now, "g": ago(1), "gopkg.in/y.v2": now, "h": ago(1)}
    again, _ = staleness.resolve(*tables, 6 * 3600, fresh=True)
    assert {r["path"]: r["source"] for r in again.where("path = 'a'").collect()} == {"a": "live"} and again.where("error is not null").select("path").distinct().count() == 5


def test_shuffled_records_hash_alike_and_unstated_arrays_are_refused(spark):
    rng = random.Random(4)
    hop = "struct<module_path:string,symbol:string>"
    schema = f"id int, findings array<struct<id:string,fixed_in:string,affected_symbols:array<string>,aliases:array<string>,references:array<struct<url:string,type:string>>,reachable:struct<is_reachable:boolean,routes:array<array<{hop}>>>>>"
    route = lambda: [(rng.choice("ab"), rng.choice("xy")) for _ in range(rng.randrange(1, 4))]
    findings = [(f"V{i % 3}", rng.choice(["v1", None]), rng.sample("pqrs", 3), rng.sample("klmn", rng.randrange(4)) or None, [(rng.choice("uv"), rng.choice(["FIX", "WEB"])) for _ in range(3)], rng.choice([None, (True, [route() for _ in range(3)])])) for i in range(6)]

    def shuffled(x):
        x = list(x)
        rng.shuffle(x)
        return x

    rows = [(0, None), (1, [])] + [(2, [(i, f, shuffled(s), a and shuffled(a), shuffled(r), c and (c[0], shuffled(c[1]))) for i, f, s, a, r, c in shuffled(findings)]) for _ in range(6)]
    turned = [(i, f, s, a, r, c and (c[0], [p[::-1] for p in c[1]])) for i, f, s, a, r, c in findings]
    df = spark.createDataFrame([*rows, (3, turned), (4, findings[:-1])], schema)
    out = seal.sealed(df, ["findings"], seal.VULNERABILITY).collect()
    hashes = {}
    for r in out:
        hashes.setdefault(r["id"], set()).add(r["content_hash"])
    assert all(len(h) == 1 for h in hashes.values()) and len(set.union(*hashes.values())) == 5
    assert out[0]["findings"] is None and out[1]["findings"] == []
    assert [f["id"] for f in out[2]["findings"]] == ["V0", "V0", "V1", "V1", "V2", "V2"]
    with pytest.raises(seal.NoOrder, match="aliases"):
        seal.sealed(df, ["findings"], {k: v for k, v in seal.VULNERABILITY.items() if "aliases" not in k})
    with pytest.raises(seal.NoOrder, match="map"):
        seal.sealed(df.withColumn("m", F.create_map(F.lit("a"), F.lit(1))), ["m"], seal.VULNERABILITY)
