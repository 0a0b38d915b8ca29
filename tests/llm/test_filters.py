import random
import re

import numpy as np
from pyspark.sql import functions as F

from depquarry.llm import decontam, toxicity
from depquarry.llm.decontam import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for a in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if names := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= names
        out.append((d, len(w), len(hit), sorted(found, key=str)))
    return sorted(out, key=str)


def test_windows_against_brute_force(spark, make_docs, monkeypatch):
    rng = random.Random(6)
    v = [f"w{i}" for i in range(30)] + ["É", "Zz"]
    items = [(i, " ".join(rng.choices(v, k=rng.choice([1, 2, 3, 9, 10, 11, 40])))) for i in range(40)] + [(90, None), (91, ""), (92, "..."), (5, "w1 w2 w3 w4"), (5, "w1 w2 w3 w4")]
    docs = []
    for d in range(60):
        w = rng.choices(v, k=rng.choice([0, 1, 5, 60]))
        if rng.random() < 0.6:
            w += re.sub(r"\bw", "W", rng.choice(items)[1] or "").split() + rng.choices(v, k=3)
        docs.append((d, ", ".join(w)))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (102, docs[0][1]), (None, items[0][1])]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_hit int")
    for bits in (1 << 26, 1 << 15):  # the small one lets much through that meets nothing
        monkeypatch.setattr(decontam, "BITMAP_BITS", bits)
        got = decontaminate(make_docs([(*x, 7) for x in docs], ", n_hit int"), bench).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=str) == brute(docs, items)
        assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)


def test_empty_benchmark_and_no_documents(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontaminate(make_docs([(1, "a b c")]), none).collect()] == [0]
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate(make_docs([]), some).count() == 0


def sample(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = [rng.choice("the of and stone river paper candle winter forest mirror".split()) for _ in range(rng.randrange(5, 60))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["scumble", "scumward", "vileness", "vilely"])
        out.append((" ".join(w), y))
    return out


def test_classifier_learns_and_generalises_over_suffixes(spark, make_docs):
    data = sample(600, 1)
    docs = make_docs([(i, t, "en") for i, (t, _) in enumerate(data)] + [(9000, None, "en"), (9001, "", None)], ", lang string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)] + [(9000, None), (None, 1), (77777, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    known = toxicity.Features(model.settings.buckets)
    fresh = [(t.replace("scumble", "scumster").replace("vilely", "vilesome"), y) for t, y in sample(300, 2)]
    s, y = model.score([t for t, _ in fresh], known), np.array([y for _, y in fresh])
    assert ((s >= 0.5) == y).mean() > 0.95
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs.withColumn("score", F.lit("x")), model).collect()}
    assert all(0 <= v <= 1 for v in scored.values()) and scored[9000] == scored[9001]
    long = "stone " * 200_000 + "scumble vileness scumble"
    assert model.score([long], known)[0] > 0.5 > model.score(["stone " * 200_000], known)[0]


def test_classifier_learns_from_all_labels(spark, make_docs):
    rng = random.Random(4)
    plain = "the of and stone river paper candle winter forest mirror".split()
    text = lambda *more: " ".join(rng.sample([*rng.choices(plain, k=6), *more], 6 + len(more)))
    by_hash = [r["id"] for r in spark.range(9000).orderBy(F.xxhash64("id"), "id").collect()]
    # the last toxic ids by hash use another word, which 3000 of each label don't hold
    toxic = [(d, text("scumble" if k < 3500 else "gorblight"), 1) for k, d in enumerate(x for x in by_hash if x % 2)]
    clean = [(d, text(), 0) for d in by_hash if d % 2 == 0]
    rows = toxic + clean
    docs = make_docs([(d, t, "en" if d % 3 else None) for d, t, _ in rows], ", lang string")
    model = toxicity.fit(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"), F.lit(True))
    known = toxicity.Features(model.settings.buckets)
    got = model.score(["the stone gorblight river paper", "the stone scumble river paper", "the stone winter river paper"], known)
    assert (got >= 0.5).tolist() == [True, True, False] and set(model.thresholds) == {"", "en"}


def test_texts_without_a_label_are_not_shuffled(spark, make_docs, monkeypatch):
    rng = random.Random(8)
    text = lambda: " ".join(f"{rng.getrandbits(64):x}" for _ in range(300))
    rows = [(d, text(), "en") for d in range(2000)] + [(None, text(), "en"), (7, "a", "de"), (8, None, "en")]
    docs = make_docs(rows, ", lang string").withColumn("doc_id", F.col("doc_id").cast("int"))
    marks = [(d, d % 2) for d in range(40)] + [(3, 0), (4, 1), (None, 1), (9999, 1), (5, None), (1 << 40, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    wide = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    for bits in (toxicity.BITMAP_BITS, 1 << 15):
        monkeypatch.setattr(toxicity, "BITMAP_BITS", bits)
        got = toxicity.labelled(wide, labels.where("doc_id is not null and toxic is not null"), 40, F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int")).collect()
        want = {d: (1 if d == 4 else d % 2, "a" if d == 7 and rows[7][1] > "a" else rows[d][1]) for d in range(40)}
        assert {r["doc_id"]: (r["toxic"], r["text"]) for r in got if r["doc_id"] not in (7, 8)} == {d: v for d, v in want.items() if d not in (7, 8)}
        assert len(got) == 40 and {r["doc_id"]: r["text"] for r in got}[8] is None
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in map(seq.apply, range(seq.size()))} if (seq := store.stageList(None, False, False, none, None)) else {}
    before, at = stages(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = toxicity.fit(docs, labels, F.lit(True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
    shuffled = sum(n for k, n in stages().items() if k not in before)
    assert model.thresholds and shuffled < 0.2 * sum(len(r[1] or "") for r in rows)


def test_thresholds_from_counts_are_those_of_the_rows():
    rng = np.random.default_rng(3)
    scores, y = rng.random(500).round(3), rng.integers(0, 2, 500)
    counts = np.zeros((2, 92), np.int64)
    np.add.at(counts, (y, (scores[:, None] >= toxicity.GRID).sum(axis=1)), 1)
    f1 = [2 * ((scores >= t) & (y == 1)).sum() / max(1, (scores >= t).sum() + (y == 1).sum()) for t in toxicity.GRID]
    assert f1[int(np.abs(toxicity.GRID - toxicity.best_threshold(counts)).argmin())] == max(f1)
    assert toxicity.best_threshold(np.zeros((2, 92))) == 0.5


def test_no_labels_and_one_label(spark, make_docs):
    docs = make_docs([(1, "a"), (2, "b")])
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    for usable in (F.lit(False), F.lit(True)):
        m = toxicity.fit(docs, labels, usable)
        assert {0 <= r["score"] <= 1 for r in toxicity.score(docs, m).collect()} == {True}
    assert toxicity.score(make_docs([]), m).count() == 0


def test_pipeline_against_its_parts_by_brute_force(spark, small):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from depquarry.llm.queries import tokenizer_file
    from test_minhash import brute as near_brute

    rows = [(r["doc_id"], r["text"]) for r in corpus_pipeline.reject_toxic(spark, spark.read.parquet(f"{small}/documents.parquet"), small).select("doc_id", "text").collect()]
    kept = {d for d, (_, c) in near_brute(rows, 5).items() if d == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = [(d, t) for d, t in rows if d in kept]
    clean = {d for d, _, n, _ in brute(left, items) if n == 0}
    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = {d: t.encode(x, add_special_tokens=False).ids for d, x in left if d in clean}
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in corpus_pipeline.run(spark, small).collect()}
    assert got == want


def test_very_long_texts_and_items_and_a_plan_that_joins_on_tokens(spark, make_docs):
    rng = random.Random(9)
    long = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    item = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    docs = [(1, " ".join(long[:60_000] + item[100:130] + long[60_000:])), (2, " ".join(long)), (3, " ".join(item)), (4, " ".join(item[:9]))] + [(5, " ".join(item[-12:]))] * 50
    items = [(7, " ".join(item)), (8, " ".join(item[:40])), (None, " ".join(item[50:70]))]
    found = decontaminate(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"))
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    want = brute(docs, [i for i in items if i[0] is not None])
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()), key=str) == want


def test_spans_are_merged(spark):
    rows = [([(5, 9), (1, 3), (2, 4), (4, 5), (20, 30), (21, 22)],), ([],)]
    df = spark.createDataFrame(rows, "p array<struct<start:int,end:int>>")
    assert [[tuple(x) for x in r[0]] for r in df.select(decontam.merged_spans(F.col("p"))).collect()] == [[(1, 9), (20, 30)], []]
