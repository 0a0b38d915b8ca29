import heapq
import hashlib
import random

from pyspark.sql import functions as F

from depquarry.operators import graph, resolve, rollup


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def req(spark, *rows):
    return spark.createDataFrame([(*r, "1.21") if len(r) == 4 else r for r in rows], "path string, version string, req_path string, req_version string, go_version string")


def selected(n):
    return {(r["path"], r["version"]) for r in n.collect()}


def pairs(e):
    return {(f"{r['from_path']}@{r['from_version']}", f"{r['to_path']}@{r['to_version']}") for r in e.collect()}


def test_closure_excludes_the_origin_and_ends_on_cycles(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("b", "b"), ("x", "a"))
    assert {r["node"] for r in graph.reachable(e, nodes(spark, "a")).collect()} == {"b", "c"}
    assert graph.reachable(e, nodes(spark, "nowhere")).count() == 0
    assert graph.reachable(e.where("false"), nodes(spark, "a")).count() == 0


def test_traverse_keeps_edges_to_visited_nodes(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "d"))
    n, hops = graph.traverse(e, "a", 2)
    assert {(r["node"], r["depth"]) for r in n.collect()} == {("b", 1), ("c", 1), ("d", 2)}
    assert {(r["src"], r["dst"]) for r in hops.collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "d")}


def test_shortest_path_breaks_ties_by_predecessor(spark):
    e = edges(spark, ("s", "b"), ("s", "a"), ("a", "t"), ("b", "t"), ("t", "u"))
    assert [r["path"] for r in graph.shortest_path(e, nodes(spark, "s"), nodes(spark, "t", "u")).collect()] == [["s", "a", "t"]]
    assert graph.shortest_path(e, nodes(spark, "u"), nodes(spark, "s")).count() == 0


def test_widest_path_against_brute_force(spark):
    rng = random.Random(5)
    raw = {(rng.randrange(12), rng.randrange(12)): rng.randrange(5) for _ in range(30)}
    e = spark.createDataFrame([(str(a), str(b), r) for (a, b), r in raw.items()], "src string, dst string, rank int")
    got = {r["node"]: r["rank"] for r in graph.widest_paths(e, nodes(spark, "0")).collect()}
    want = {0: 5}
    for _ in range(20):
        for (a, b), r in raw.items():
            if a in want:
                want[b] = max(want.get(b, -1), min(want[a], r))
    assert got == {str(k): v for k, v in want.items()}


def test_widest_path_depths_and_predecessors_against_brute_force(spark):
    rng = random.Random(11)
    raw = {(str(rng.randrange(15)), str(rng.randrange(15))): rng.choice([4, 4, 3, 1, 0]) for _ in range(45)}
    rows = [(a, b, r) for (a, b), r in raw.items()] + [(a, b, 0) for a, b in list(raw)[:5]] + [("0", None, 4), (None, "3", 4), ("0", "null", None)]
    got = {r["node"]: (r["rank"], r["depth"], r["pred"]) for r in graph.widest_paths(spark.createDataFrame(rows, "src string, dst string, rank int"), nodes(spark, "0")).collect()}
    want, heap = {}, [(-5, 0, "", "0")]
    while heap:
        down, depth, pred, n = heapq.heappop(heap)
        if n not in want:
            want[n] = (-down, depth, pred or None)
            for (a, b), r in raw.items():
                if a == n and b not in want:
                    heapq.heappush(heap, (-min(-down, r), depth + 1, n, b))
    assert got == want


def test_widest_path_carries_the_depth_of_the_settled_predecessor(spark):
    # x is strong by a long path, weak by a short one; y hangs on x by a weak edge
    e = spark.createDataFrame([("r", "a", 4), ("a", "b", 4), ("b", "x", 4), ("r", "x", 1), ("x", "y", 1)], "src string, dst string, rank int")
    got = {r["node"]: (r["rank"], r["depth"], r["pred"]) for r in graph.widest_paths(e, nodes(spark, "r")).collect()}
    assert got["x"] == (4, 3, "b") and got["y"] == (1, 4, "x")


def test_diamond_selects_the_newest_and_moves_edges(spark):
    n, e = resolve.select_versions(req(spark, ("a", "v1.0.0", "b", "v1.0.0"), ("a", "v1.0.0", "c", "v1.0.0"), ("b", "v1.0.0", "d", "v1.1.0"), ("c", "v1.0.0", "d", "v1.2.0")), ("a", "v1.0.0"))
    # requirements of pruned modules are no root requirements, but they are nodes
    assert selected(n) == {("a", "v1.0.0"), ("b", "v1.0.0"), ("c", "v1.0.0"), ("d", "v1.2.0")}
    assert {p for p in pairs(e) if p[1].startswith("d@")} == {("b@v1.0.0", "d@v1.2.0"), ("c@v1.0.0", "d@v1.2.0")}


def test_a_later_wave_bumps_a_version(spark):
    n, _ = resolve.select_versions(req(spark, ("a", "v1.0.0", "b", "v1.0.0"), ("a", "v1.0.0", "c", "v1.0.0"), ("b", "v1.0.0", "c", "v1.10.0"), ("c", "v1.10.0", "d", "v0.1.0")), ("a", "v1.0.0"))
    assert selected(n) == {("a", "v1.0.0"), ("b", "v1.0.0"), ("c", "v1.10.0"), ("d", "v0.1.0")}


def test_replace_and_exclude(spark):
    rows = req(spark, ("a", "v1.0.0", "b", "v1.0.0"), ("a", "v1.0.0", "x", "v1.0.0"), ("fork", "v9.0.0", "d", "v1.0.0"))
    repl = spark.createDataFrame([("b", "", "fork", "v8.0.0"), ("b", "v1.0.0", "fork", "v9.0.0")], "old_path string, old_version string, new_path string, new_version string")
    excl = spark.createDataFrame([("x", "v1.0.0")], "path string, version string")
    n, e = resolve.select_versions(rows, ("a", "v1.0.0"), repl, excl)
    assert selected(n) == {("a", "v1.0.0"), ("fork", "v9.0.0"), ("d", "v1.0.0")}
    assert ("a@v1.0.0", "fork@v9.0.0") in pairs(e)


def test_pruned_modules_are_not_expanded_beyond_roots(spark):
    rows = req(spark, ("a", "v1.0.0", "b", "v1.0.0", "1.21"), ("b", "v1.0.0", "c", "v1.0.0", "1.21"), ("c", "v1.0.0", "d", "v1.0.0", "1.21"))
    assert selected(resolve.select_versions(rows, ("a", "v1.0.0"))[0]) == {("a", "v1.0.0"), ("b", "v1.0.0"), ("c", "v1.0.0")}
    old = rows.withColumn("go_version", F.when(F.col("path") == "b", "1.16").otherwise(F.col("go_version")))
    assert ("d", "v1.0.0") in selected(resolve.select_versions(old, ("a", "v1.0.0"))[0])
    # what a module at the bound requires is recorded, but not followed
    assert selected(resolve.select_versions(old, ("a", "v1.0.0"), max_depth=1)[0]) == {("a", "v1.0.0"), ("b", "v1.0.0"), ("c", "v1.0.0")}


def test_merkle_roots_are_those_of_the_recursive_definition(spark):
    def root(x):
        if len(x) == 1:
            return hashlib.sha256(b"\0" + x[0]).digest()
        k = 1
        while k * 2 < len(x):
            k *= 2
        return hashlib.sha256(b"\1" + root(x[:k]) + root(x[k:])).digest()

    rows = [(n, i, f"{n}-{i}") for n in (1, 2, 3, 5, 8, 13) for i in range(n)]
    df = spark.createDataFrame(rows, "n int, i int, d string")
    got = {r["n"]: r["root"] for r in rollup.merkle_roots(df, ["n"], "i", F.col("d")).collect()}
    assert got == {n: root([f"{n}-{i}".encode() for i in range(n)]).hex() for n in (1, 2, 3, 5, 8, 13)}
    assert rollup.merkle_roots(df.where("false"), ["n"], "i", F.col("d")).count() == 0


def test_ancestry_prefers_calls_to_references(spark):
    e = spark.createDataFrame(
        [("main", "reg", 4, True), ("reg", "t", 4, False), ("main", "f", 4, False), ("f", "t", 1, False), ("init", "reg", 4, False), ("init", "reg", 2, True), ("run", "reg", 3, True), ("run", "reg", 2, None)],
        "src string, dst string, rank int, reference boolean",
    )
    got = {tuple(r) for r in graph.entry_ancestry(e, "t", nodes(spark, "main", "init", "run")).collect()}
    assert got == {("main", 2, 1, False), ("init", 2, 4, False), ("run", 2, 2, False)}
    only = graph.entry_ancestry(e.where("src <> 'f'"), "t", nodes(spark, "main")).collect()
    assert [tuple(r) for r in only] == [("main", 2, 4, True)]
    assert [tuple(r) for r in graph.entry_ancestry(e.drop("reference"), "t", nodes(spark, "main")).collect()] == [("main", 2, 4, False)]


def test_places_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(50), rng.randrange(10**6)) for _ in range(500)]
    got = rollup.placed(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"])
    assert [(r["a"], r["b"], r["place"]) for r in sorted(got.collect(), key=lambda r: r["place"])] == [(*r, i + 1) for i, r in enumerate(sorted(rows))]
    assert rollup.placed(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_places_within_groups_over_many_ranges(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 2 else rng.choice(["a", "b", None]), i) for i in rng.sample(range(2000), 600)]
    got = {(r["k"], r["i"]): r["place"] for r in rollup.placed_in(spark.createDataFrame(rows, "k string, i int").repartition(5), ["k"], "i").collect()}
    assert got == {(k, i): 1 + sum(k == k2 and j < i for k2, j in rows) for k, i in rows}


def test_fault_bounds_over_blocks_are_those_of_one_window(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", None]), rng.choice([None, None, None, 1000 + i])) for i in range(200)] + [(i, "b", None) for i in range(200, 230)]
    df = spark.createDataFrame(rows, "i int, k string, at int")
    for keys in (None, ["k"]):
        one = rollup.fault_bounds(df, "i", "at", keys).collect()
        parts = rollup.fault_bounds(df, "i", "at", keys, block=F.floor(F.col("i") / 7)).select("i", "k", "at", "after", "before").collect()
        assert sorted(map(tuple, parts), key=lambda r: r[0]) == sorted(map(tuple, one), key=lambda r: r[0])


def test_edge_order_covers_every_edge(spark, small):
    from depquarry.plans.carriers import carrier
    from depquarry.plans.registry import QUERIES

    assert QUERIES["srt_01_total_edge_order"](spark, small).count() == carrier(spark, small, "deps").count()


def test_run_totals_count_every_event(spark, small):
    from depquarry.plans.registry import QUERIES

    total = QUERIES["agg_07_run_status_all_events"](spark, small).agg(F.sum("total")).first()[0]
    assert total == spark.read.parquet(f"{small}/events.parquet").count()


def test_walks_take_repeated_edges_as_they_come(spark, small, monkeypatch):
    from pyspark.sql import functions as F

    from depquarry.operators import graph
    from depquarry.plans.carriers import carrier

    monkeypatch.setattr(graph, "FRONTIER_ROWS", 3)  # some rounds broadcast, others shuffle
    every = carrier(spark, small, "deps", distinct=False)
    assert "Aggregate" not in every._jdf.queryExecution().optimizedPlan().toString()
    assert every.distinct().exceptAll(carrier(spark, small, "deps")).isEmpty()
    one = spark.createDataFrame([("o7",)], "node string")
    rank = lambda e: e.select("src", "dst", graph.confidence_rank(F.col("confidence")).alias("rank"))
    for f in (lambda e: graph.levels(e, one), lambda e: graph.widest_paths(rank(e), one)):
        assert sorted(f(every).collect()) == sorted(f(carrier(spark, small, "deps")).collect())
