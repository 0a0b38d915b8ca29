import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from depquarry.llm import winnow


def brute(spark, text):
    units = re.findall(r"\S{1,4}", text or "", re.ASCII)
    if not units:
        return []
    h = [r["h"] for r in spark.createDataFrame(list(enumerate(units)), "i int, u string").select("i", F.shiftrightunsigned(F.xxhash64("u"), 34).alias("h")).orderBy("i").collect()]
    k = min(winnow.GRAM, len(h)) if len(h) >= winnow.GRAM else len(h)
    if len(h) < winnow.GRAM:
        acc = len(h)
        for x in h:
            acc = (acc * winnow.BASE + x) % winnow.PRIME
        grams = [acc]
    else:
        grams = []
        for i in range(len(h) - k + 1):
            acc = 0
            for x in h[i : i + k]:
                acc = (acc * winnow.BASE + x) % winnow.PRIME
            grams.append(acc)
    w = min(winnow.WINDOW, len(grams))
    kept = []
    for i in range(len(grams) - w + 1):
        at = max(range(i, i + w), key=lambda j: (-grams[j], j))
        if (grams[at], at) not in kept:
            kept.append((grams[at], at))
    return kept


@pytest.mark.parametrize("text", ["", " ", "a", "abcde fg", "one two three four five six", "same same same same same same same same same same same same same", "ünï cödé 😀😀😀😀😀 " * 9])
def test_kept_grams_against_brute_force(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(winnow.kept_grams(F.col("t")).alias("k")).select("k", winnow.positions(F.col("k")).alias("p")).first()
    assert [(x >> 32, p) for x, p in zip(r["k"], r["p"])] == brute(spark, text)


def test_edits_of_the_next_document(spark, make_docs):
    rng = random.Random(3)
    words = [f"{rng.randrange(10**6):x}" for _ in range(300)]
    rows = [(i * 7 % 101, " ".join(rng.choices(words, k=rng.choice([1, 5, 80, 200])))) for i in range(40)] + [(500, None), (501, "")]
    got = {r["doc_id"]: r for r in winnow.fingerprint_edits(make_docs(rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        m = len(t) // 3
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + n[:m]).encode()).hexdigest()
        assert 0 <= got[d]["near_next"] <= 1 and 0 <= got[d]["near_edited"] <= 1
        if len(t) > 300:
            assert got[d]["near_edited"] > 0.3 > got[d]["near_next"]


def test_one_row_no_rows_repeats_and_nulls(spark, make_docs):
    assert winnow.fingerprint_edits(make_docs([])).count() == 0
    one = winnow.fingerprint_edits(make_docs([(1, "abcdef")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1
    many = winnow.fingerprint_edits(make_docs([(1, "a b c"), (1, "a b c"), (None, "x"), (None, None)])).collect()
    assert len(many) == 4 and len({r["fingerprint"] for r in many if r["doc_id"] == 1}) == 1


def test_passages_without_white_space_are_found_at_every_alignment(spark, make_docs):
    rng = random.Random(5)
    sign = lambda n: "".join(chr(0x4E00 + rng.randrange(8000)) for _ in range(n))
    base = sign(900) + "😀" + sign(600)
    rows = [(k, sign(k) + base) for k in range(5)] + [(5, "\u3042"), (6, " \n"), (7, None), (8, "a" * 40)]
    k = {r["doc_id"]: r for r in make_docs(rows).select("doc_id", winnow.kept_spans(F.col("text")).alias("k")).select("*", winnow.hashes(F.col("k")).alias("h"), winnow.positions(F.col("k")).alias("p")).collect()}
    for i in range(1, 5):
        both = set(k[0]["h"]) & set(k[i]["h"])
        assert len(both) / len(set(k[0]["h"]) | set(k[i]["h"])) > 0.95
    assert (len(k[5]["k"]), k[6]["k"], k[7]["k"]) == (1, [], []) and k[8]["p"] == [24]
    passage = sign(winnow.SPAN + winnow.REACH - 1)
    pairs = [(sign(rng.randrange(90)) + passage + sign(50), sign(rng.randrange(90)) + passage + sign(50)) for _ in range(40)]
    x = spark.createDataFrame(pairs, "a string, b string").select(*[winnow.hashes(winnow.kept_spans(F.col(c))).alias(c) for c in "ab"])
    assert x.where(F.arrays_overlap("a", "b")).count() == 40


def test_the_query_takes_grams_at_every_code_point(spark, make_docs):
    rng = random.Random(6)
    base = "".join(chr(0x4E00 + rng.randrange(8000)) for _ in range(3000))
    got = {r["doc_id"]: r for r in winnow.fingerprint_edits(make_docs([(2, "\u3042" + base), (1, base)])).collect()}
    assert got[1]["near_next"] > 0.95 and got[2]["near_next"] > 0.95


def test_kept_spans_against_brute_force(spark):
    text = "ab \u00fc\n\ud83d\ude00cd efgh ".encode("utf-16", "surrogatepass").decode("utf-16") * 12
    solid = "".join(text.split())
    grams = [solid[i : i + winnow.SPAN] for i in range(len(solid) - winnow.SPAN + 1)]
    of = {r["g"]: r["h"] for r in spark.createDataFrame([(g,) for g in set(grams)], "g string").select("g", F.shiftrightunsigned(F.xxhash64("g"), 33).alias("h")).collect()}
    h = [of[g] for g in grams]
    want = {(h[at], at) for i in range(len(h) - winnow.REACH + 1) for at in [max(range(i, i + winnow.REACH), key=lambda j: (-h[j], j))]}
    r = spark.createDataFrame([(text,)], "t string").select(winnow.kept_spans(F.col("t")).alias("k")).select("k", winnow.positions(F.col("k")).alias("p")).first()
    assert {(x >> 32, p) for x, p in zip(r["k"], r["p"])} == want


def test_edited_fingerprints_are_those_of_the_edited_texts(spark, make_docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc\u00e9\U0001f600") for _ in range(rng.choice([1, 2, 9])))
    of = lambda k: rng.choice(["", " ", "\n\n"]).join(word() for _ in range(k))
    rows = [(i, of(rng.choice([0, 1, 3, 10, 12, 15, 18, 25, 40, 90, 300]))) for i in range(260)]
    rows += [(1000, "a" * 500), (1001, "b" * 60 + " " * 80), (1002, "ab" * 300), (1003, " " * 200 + "c" * 47), (1004, "same " * 90), (1005, "same " * 90)]
    texts = [t for _, t in sorted(rows, reverse=True)]
    edited = {d: t[: len(t) - len(t) // 3] + n[: len(t) // 3] for (d, t), n in zip(sorted(rows, reverse=True), texts[1:] + texts[:1])}
    got = winnow.fingerprint_edits(make_docs(rows)).select("doc_id", "edited_fingerprint")
    want = make_docs(list(edited.items())).select("doc_id", winnow.kept_spans(F.col("text")).cast("string").alias("edited_fingerprint"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
