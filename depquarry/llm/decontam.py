"""Benchmark decontamination: which words of a document lie in a window that a benchmark item has too.

A prefix-filtered set join. A window is ``window`` consecutive words of an item (all its words, if
fewer); its tokens are its shingles of ``shingle`` words. As every token of a window must occur for the
window to be contained, one token is a sufficient prefix: the rarest over all documents, and a window
one of whose tokens no document has is ruled out. A document's shingles are joined with these prefix
tokens; where one is met, the window can lie in one place only, which must fit between the document's
ends (positional and length bounds), and there the words are compared themselves.

Before the join, shingles pass a bitmap of the benchmark's tokens, of a size that is fixed: it lets few
others through, which then meet nothing. So what is shuffled are places of prefix tokens, with the few
words around them, and the benchmark may be of any size. A text is named by its 64-bit hash, by which what was
found in it comes back to its documents; so the texts themselves are shuffled only if they are asked for.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depquarry.llm.common import sliced, small_batches, written
from depquarry.llm.minhash import WordHashes, mix

#: A-Z to a-z, every other ASCII byte that is no letter or digit to a blank.
WORDS_ONLY = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isascii() and chr(c).isupper() else 32 for c in range(256))

#: Bits of the bitmap that shingles have to pass before they are joined: 8 MB in all, whatever the benchmark.
BITMAP_BITS = 1 << 26
#: Bits in a piece of it, as Spark's bitmaps are cut.
PIECE_BITS = 1 << 15

#: Different tokens that a task counts before it hands the counts on.
MOST_COUNTS = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS_ONLY).split()


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words that start at each place."""
    acc = h[: len(h) - size + 1] + np.uint64(size)
    for i in range(1, size):
        acc = mix(acc) + h[i : len(h) - size + 1 + i]
    return mix(acc)


def windows_of(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item_id, w, size, tokens): each item's windows, as words joined by blanks, with the hashes of their shingles in order."""
    id_type = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches):
        known = WordHashes()
        for batch in sliced(batches, 200):
            ids, ws, sizes, tokens = [], [], [], []

            def made():
                of = [pa.array(ids, batch.schema.field("item_id").type), pa.array(ws, pa.string()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))]  # noqa: B023
                return pa.RecordBatch.from_arrays(of, ["item_id", "w", "size", "tokens"])

            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                if not size:
                    continue
                s = min(shingle, size)
                t = shingles(np.array([known[x] for x in words], np.uint64), s).view(np.int64)
                for i in range(len(words) - size + 1):
                    ids.append(item)
                    ws.append(b" ".join(words[i : i + size]).decode("utf-8", "replace"))
                    sizes.append(size)
                    tokens.append(t[i : i + size - s + 1])
                    if len(ids) >= 10_000:
                        yield made()
                        ids, ws, sizes, tokens = [], [], [], []
            yield made()

    return benchmark.select("item_id", "text").where("text is not null").mapInArrow(run, f"item_id {id_type}, w string, size int, tokens array<bigint>")


def place(token: Column) -> Column:
    """The bit of a token, from 1."""
    return F.pmod(token, F.lit(BITMAP_BITS)) + 1


def bitmap(tokens: DataFrame) -> np.ndarray:
    """The bits of all ``tokens`` (token), as bytes: at most BITMAP_BITS of them come to the driver."""
    at = place(F.col("token"))
    rows = tokens.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in rows:
        start = (r["piece"] - 1) * PIECE_BITS // 8
        out[start : start + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def passing(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The places of the hashes whose bit is set."""
    at = h & np.uint64(8 * len(bits) - 1)
    return np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)


def token_counts(docs: DataFrame, sizes: list[int], bits) -> DataFrame:
    """(token, n): in how many documents (text) each token of the benchmark stands; ``bits`` is a broadcast bitmap."""

    def run(batches):
        known, counts = WordHashes(), defaultdict(int)

        def flush():
            tokens = np.fromiter(counts.keys(), np.uint64, len(counts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], ["token", "n"])
            counts.clear()

        for batch in sliced(batches):
            for text in batch.column("text"):
                words = words_of(text.as_py())
                h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                for size in sizes:
                    if len(h) >= size:
                        s = shingles(h, size)
                        for token in np.unique(s[passing(s, bits.value)]).tolist():
                            counts[token] += 1
            if len(counts) > MOST_COUNTS:
                yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def token_places(docs: DataFrame, sizes: list[int], bits, window: int) -> DataFrame:
    """(key, token, at, first, near): where tokens that pass stand in each text (key, text), with the words from ``first`` on around them.

    Each text has one row without a token besides, whose ``at`` is the number of its words.
    """

    def run(batches):
        known = WordHashes()
        for batch in sliced(batches):
            keys, tokens, ats, firsts, nears = [], [], [], [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                for column, value in zip((keys, tokens, ats, firsts, nears), (key, None, len(words), None, None), strict=True):
                    column.append(value)
                h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) if sizes else ()
                for size in sizes:
                    if len(h) < size:
                        continue
                    s = shingles(h, size)
                    on = passing(s, bits.value)
                    for p, token in zip(on.tolist(), s[on].view(np.int64).tolist(), strict=True):
                        first = max(0, p + size - window)
                        keys.append(key)
                        tokens.append(token)
                        ats.append(p)
                        firsts.append(first)
                        nears.append(b" ".join(words[first : p + window]).decode("utf-8", "replace"))
            for i in range(0, len(keys), 10_000):
                part = slice(i, i + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part], pa.int64()), pa.array(tokens[part], pa.int64()), pa.array(ats[part], pa.int32()), pa.array(firsts[part], pa.int32()), pa.array(nears[part], pa.string())], ["key", "token", "at", "first", "near"])

    return docs.mapInArrow(run, "key long, token long, at int, first int, near string")


def merged_spans(places: Column) -> Column:
    """Sorted (start, end) ranges without overlaps, of ranges in any order; neighbours that touch are one."""

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (x["start"] <= last["end"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.sort_array(places), F.array().cast("array<struct<start:int,end:int>>"), step)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (ascending as text) and spans (array of hit word ranges [start, end)).

    ``docs`` has text and ``benchmark`` (item_id, text) beside any other columns; columns of ``docs`` that
    clash with the added ones are replaced. Null texts and items have no words; an empty benchmark or one
    without words hits nothing. Equal item_ids count once, a null item_id not at all; its windows hit.
    Repeated documents have a row each. ``docs`` is read three times.
    """
    sc = docs.sparkSession.sparkContext
    small_batches(docs)
    windows = written(windows_of(benchmark, window, shingle), "decontam-windows")
    sizes = sorted(r["s"] for r in windows.select(F.least(F.lit(shingle), F.col("size")).alias("s")).distinct().collect())  # at most ``shingle`` rows
    once = windows.groupBy("w").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"))
    tokens = once.select("w", "size", F.posexplode("tokens").alias("offset", "token"))

    rarity = token_counts(docs, sizes, sc.broadcast(bitmap(windows.select(F.explode("tokens").alias("token")))))
    rare = tokens.join(rarity, "token", "left").groupBy("w").agg(F.first("size").alias("size"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("r"))
    prefixes = written(rare.where("r.n > 0").select("w", "size", "r.token", "r.offset"), "decontam-prefixes")

    key = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    texts = docs.where("text is not null").select(key.alias("key"), "text")
    places = written(token_places(texts, sizes, sc.broadcast(bitmap(prefixes.select("token"))), window), "decontam-places")
    words = places.where("token is null").groupBy("key").agg(F.max("at").alias("n_words"))
    near = places.where("token is not null")
    start = F.col("at") - F.col("offset")
    met = near.distinct().join(prefixes, "token").where(start >= F.col("first"))
    there = F.array_join(F.slice(F.split("near", " "), start - F.col("first") + 1, F.col("size")), " ")
    found = written(met.where(there == F.col("w")).select("key", "w", F.struct(start.alias("start"), (start + F.col("size")).alias("end")).alias("at")), "decontam-found")
    spans = found.groupBy("key").agg(merged_spans(F.collect_set("at")).alias("spans"))
    named = found.select("key", "w").distinct().join(windows.select("w", "item_id").distinct(), "w")
    items = named.groupBy("key").agg(F.collect_set("item_id").alias("item_ids"))
    result = words.join(spans, "key", "left").join(items, "key", "left").withColumnRenamed("key", "_key")

    added = {"n_words": "long", "n_hit": "long", "item_ids": f"array<{benchmark.schema['item_id'].dataType.simpleString()}>", "spans": "array<struct<start:int,end:int>>"}
    kept = docs.select(*[c for c in docs.columns if c not in added])
    mine = [F.col(f"d.{c}") for c in kept.columns]
    out = kept.withColumn("_key", key).alias("d").join(result.alias("r"), F.col("d._key") == F.col("r._key"), "left")
    by_name = F.transform(F.sort_array(F.transform("r.item_ids", lambda i: F.struct(i.cast("string").alias("n"), i.alias("i")))), lambda x: x["i"])
    values = {
        "n_words": F.coalesce("r.n_words", F.lit(0)), "n_hit": F.coalesce(F.aggregate("r.spans", F.lit(0), lambda n, x: n + x["end"] - x["start"]), F.lit(0)),
        "item_ids": F.coalesce(by_name, F.array()), "spans": F.coalesce("r.spans", F.array()),
    }
    return out.select(*mine, *[v.cast(added[c]).alias(c) for c, v in values.items()])
