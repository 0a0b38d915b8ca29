"""Version selection against a plain one, over random graphs."""

import random

import pytest

from depquarry.operators import resolve


def number(v):
    return tuple(int(x) for x in v[1:].split("."))


def plain(requires, target, replaces=(), excludes=(), failures=(), max_depth=0, fetched=False):
    """(nodes, edges, reasons) by walking waves with dictionaries."""
    repl = {}
    for old, version, new, new_version, local in replaces:
        if not (local and fetched):
            repl.setdefault((old, version), (new, new_version, local))
    manifests = {}
    for p, v, rp, rv, go in requires:
        manifests.setdefault((p, v), []).append((rp, rv, go is None or number("v" + go) < (1, 17)))
    roots = {rp for rp, rv, _ in manifests.get(target, []) if kept(rp, rv, repl, excludes)}
    best = {target[0]: dict(asked=target[1], at=target, depth=0, expand=True, done=False, source="target", local=None)}
    edges, reasons = set(), set()
    while True:
        wave = [(own, n) for own, n in best.items() if n["expand"] and not n["done"] and n["source"] != "local_replace"]
        if not wave:
            break
        asks = {}
        for _, n in wave:
            n["done"] = True
            if n["at"] in dict(failures):
                n["source"] = dict(failures)[n["at"]]
                continue
        seen = set()
        for _, n in wave:
            if n["at"] in dict(failures) or (n["at"], n["depth"]) in seen:
                continue
            seen.add((n["at"], n["depth"]))
            for rp, rv, old in manifests.get(n["at"], []):
                if not kept(rp, rv, repl, excludes):
                    continue
                new, nv, local = repl.get((rp, rv)) or repl.get((rp, "")) or (rp, rv, None)
                source = "mvs" if local is None else "local_replace" if local else "replace"
                to = (rp, rv) if source != "replace" else (new, nv)
                bounded = bool(max_depth) and n["depth"] >= max_depth and source != "local_replace"
                if bounded:
                    reasons.add(f"depth_bounded: max_depth={max_depth}")
                edges.add((n["at"], to, rv, rp, source == "replace"))
                asks.setdefault(rp, []).append(dict(asked=rv, at=to, depth=n["depth"] + 1, expand=(rp in roots or old) and not bounded, source=source, local=new if source == "local_replace" else None, bounded=bounded))
        for own, all_ in asks.items():
            top = min(all_, key=lambda a: (a["bounded"], a["source"] == "local_replace", tuple(-x for x in number(a["asked"])), a["at"]))
            now = best.get(own)
            expand, depth = any(a["expand"] for a in all_), min(a["depth"] for a in all_)
            if now is None or not top["bounded"] and top["source"] != "local_replace" and number(top["asked"]) > number(now["asked"]):
                best[own] = dict(asked=top["asked"], at=top["at"], depth=min(depth, now["depth"] if now else depth), expand=expand or bool(now and now["expand"]), done=False, source=top["source"], local=top["local"])
            else:
                now["expand"], now["depth"] = now["expand"] or expand, min(now["depth"], depth)
    reasons |= {n["source"] for n in best.values()} & set(dict(failures).values())
    moved = {(*a, *(to if pinned else (to[0], best[own]["asked"])), wanted) for a, to, wanted, own, pinned in edges}
    return {(own, *n["at"], n["depth"], n["source"], n["local"]) for own, n in best.items()}, moved, sorted(reasons)


def kept(rp, rv, repl, excludes):
    new, nv, local = repl.get((rp, rv)) or repl.get((rp, "")) or (rp, rv, None)
    return bool(local) or (new, nv) not in excludes


@pytest.mark.parametrize("seed", [0, 2, 3])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    v = lambda: f"v1.{rng.randrange(12)}.{rng.randrange(2)}"
    names = [f"m{i}" for i in range(14)]
    requires = {("root", "v0.0.0", rng.choice(names), v(), "1.21") for _ in range(4)}
    for n in names:
        for version in {v() for _ in range(7)}:
            go = rng.choice(["1.16", "1.21", "1.20", None])
            requires |= {(n, version, rng.choice(names), v(), go) for _ in range(rng.randrange(4))}
    replaces = [("m1", "", "fork", "v1.3.0", False), ("m2", "v1.5.0", "../m2", "", True), ("m3", "", "/m3", "", True), ("m4", "v1.2.0", "m5", "v1.9.0", False)] if seed else []
    requires |= {("fork", "v1.3.0", "m6", "v1.11.1", "1.16")}
    excludes = [(n, w) for n in names for w in ("v1.11.0", "v1.4.0")] if seed > 1 else []
    failures = [("m7", f"v1.{i}.{j}", "fetch_failed") for i in range(12) for j in (0, 1)] if seed > 2 else []
    for depth, fetched in ((0, False), (2, True)):
        want = plain(requires, ("root", "v0.0.0"), replaces, excludes, [((p, w), r) for p, w, r in failures], depth, fetched)
        rows = lambda x, schema: spark.createDataFrame(list(x), schema)
        nodes, edges, state = resolve.resolve_graph(
            rows(requires, "path string, version string, req_path string, req_version string, go_version string"), ("root", "v0.0.0"),
            rows(replaces, "old_path string, old_version string, new_path string, new_version string, local boolean") if replaces else None,
            rows(excludes, "path string, version string") if excludes else None, rows(failures, "path string, version string, reason string") if failures else None, depth, fetched,
        )
        assert {tuple(r) for r in nodes.collect()} == want[0]
        assert {tuple(r) for r in edges.collect()} == want[1]
        s = state.collect()
        assert [(r["partial"], r["reasons"], r["has_local_replace"]) for r in s] == [(bool(want[2]), want[2], bool(replaces) and not fetched)]


def test_a_target_without_requirements(spark):
    none = spark.createDataFrame([], "path string, version string, req_path string, req_version string, go_version string")
    nodes, edges, state = resolve.resolve_graph(none, ("a", "v1.0.0"))
    assert [tuple(r) for r in nodes.collect()] == [("a", "a", "v1.0.0", 0, "target", None)] and edges.count() == 0
    assert [tuple(r) for r in state.collect()] == [(False, [], False)]
