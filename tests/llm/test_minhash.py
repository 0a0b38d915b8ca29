import gc
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from depquarry.llm import minhash
from depquarry.llm.common import written
from depquarry.llm.components import connected_components
from depquarry.llm.minhash import NearDup, near_duplicates


def sets(text, k):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent=80):
    s = [sets(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(s[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("k", [2, 5])
def test_components_are_those_of_brute_force(spark, make_docs, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 30, 120, 400]))]
        for _ in range(rng.choice([1, 3, 40])):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.04, 0.08]) else w for w in words]
            rows.append((rng.randrange(10**6) * 100 + len(rows) % 100, " ".join(copy)))
    rows += [(7, None), (9, ""), (11, " \t\n"), (13, "One"), (12, "oNE")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make_docs(rows), NearDup(shingle_words=k)).collect()}
    assert got == brute(rows, k)


def test_repeats_nulls_extra_columns_and_no_rows(spark, make_docs):
    rows = [(5, "a b c", "x"), (5, "a b c", "y"), (None, "a b c", "z"), (3, "q r s", None)]
    got = near_duplicates(make_docs(rows, ", kept string").withColumnRenamed("kept", "cls")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got) == [(-1, 5, False), (3, 3, True), (5, 5, True), (5, 5, True)]
    assert near_duplicates(make_docs([])).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert connected_components(links.where("false")).count() == 0


def test_a_row_without_an_id_links_others(spark, make_docs):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join([*words[:i], *[f"x{k}" for k in range(8)], *words[i + 8 :]]) for i in (0, 40)]
    rows = [(5, texts[0]), (3, texts[1]), (None, " ".join(words))]
    for k in (1, 2):
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make_docs(rows), NearDup(shingle_words=k)).collect()}
        assert got == {5: 3, 3: 3, None: 3}


def test_crowded_keys_are_split_by_rare_shingles(spark, make_docs, monkeypatch):
    rng = random.Random(9)
    template = [f"t{i}" for i in range(70)]
    rows = [(i, " ".join(template + [f"u{rng.randrange(10**6)}" for _ in range(12)])) for i in range(150)]
    for d, t in rows[:150:10]:  # and some that are similar enough, by chains
        w = t.split()
        w[rng.randrange(70, 82)] = "other"
        rows.append((1000 + d, " ".join(w)))
    monkeypatch.setattr(minhash, "ALL_PAIRS", 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make_docs(rows), NearDup(shingle_words=2)).collect()}
    assert got == brute(rows, 2) and len({c for _, c in got.values()}) == 150


def test_similar_sets_meet_under_rare_prefixes_and_templates_do_not(spark):
    rng = random.Random(3)
    made = []
    for t in range(4):
        template = rng.sample(range(10_000 * t, 10_000 * t + 5000), rng.choice([5, 30, 60, 200]))
        for _ in range(25):
            base = set(rng.sample(template, round(len(template) * rng.choice([0.5, 0.9, 0.97, 1]))))
            made.append(base | {rng.randrange(10**6, 10**9) for _ in range(rng.choice([0, 1, 3, 12, 30]))})
    for x in list(made):
        y = set(x)
        for item in rng.sample(sorted(y), min(len(y), rng.choice([0, 1, 2, 5]))):
            y.discard(item)
        made.append(y | {rng.randrange(10**6) * 7 for _ in range(rng.choice([0, 1, 4]))})
    made = [s for s in made if s]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(made)], "cls long, items array<long>")
    for core in (2, 64, 1000):
        under = {}
        for r in minhash.rare_prefixes(df, 80, core).collect():
            under.setdefault(r["cls"], set()).add((r["item"], r["side"]))
        for i, a in enumerate(made):
            for j in range(i):
                both = len(a & made[j])
                if 100 * both >= 80 * (len(a) + len(made[j]) - both):
                    assert any((item, -side) in under[j] for item, side in under[i]), (core, i, j)
    rows = [(i, list(range(70)) + [10**6 + 100 * i + k for k in range(12)]) for i in range(200)]
    many = minhash.rare_prefixes(spark.createDataFrame(rows, "cls long, items array<long>"), 80)
    assert many.where("side = 0").groupBy("item").count().where("count > 1").count() == 0  # sets of one template, none of which are alike


def test_a_pair_is_brought_by_the_first_of_its_keys_alone(spark):
    p, rng = NearDup(), random.Random(3)
    base = [rng.randrange(1 << 16) for _ in range(80)]
    rows = [(i, 9, struct.pack("<80H", *[b if rng.random() < 0.8 else rng.randrange(1 << 16) for b in base])) for i in range(12)]
    entries = minhash.index_entries(spark.createDataFrame(rows, "cls long, n long, sig binary"), p).join(spark.createDataFrame(rows, "cls long, n long, sig binary").select("cls", "sig"), "cls")
    x, y = entries.alias("x"), entries.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") < F.col("y.cls")))
    slot = F.col("x.key").bitwiseAND(F.lit(minhash.slot_mask(p))).cast("int")
    first = ~minhash.meet_before(F.col("x.sig"), F.col("y.sig"), slot, p)
    n = met.groupBy("x.cls", "y.cls").agg(F.count("*").alias("keys"), F.count_if(first).alias("firsts")).collect()
    assert len(n) > 20 and sum(r["keys"] for r in n) > 3 * len(n)
    assert all(r["firsts"] == 1 for r in n)


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = lambda: sum("shuffle_" in f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(2)  # for what other tests have left
    before = files()
    out = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "left")
    until = time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and out.count() == 7
    assert connected_components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).count() == 3
