"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact confirmation.

A document's set is that of its k-word shingles. Its signature holds ``chunks * width`` symbols of
16 bits, one for each hash function. Two signatures within ``max_distance`` unequal symbols have, by
the pigeonhole principle, a chunk with at most ``max_distance // chunks`` errors. Every document is
entered in one index for each chunk and each choice of error positions, under the symbols that
remain; so all pairs within the distance meet. Documents that meet are confirmed on their full sets.

A pair of similarity 0.8 differs in a fifth of the symbols on average; the distance allowed is chosen
so that it lies over four standard deviations above that.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depquarry.llm.common import LOWER, sliced, small_batches, written
from depquarry.llm.components import connected_components

#: Of a set's bitmap, by which pairs are ruled out.
BITS = 2048

#: Under a key with more components than this, pairs are sought by shared rare shingles instead.
ALL_PAIRS = 256
#: There, shingles of more sets than this are a template's; sizes in a band differ by this factor.
CORE, BAND = 64, 1.05

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class NearDup:
    shingle_words: int = 5
    percent: int = 80
    chunks: int = 16
    width: int = 5
    errors: int = 1
    seed: int = 1

    @property
    def max_distance(self) -> int:
        """Every pair of signatures within so many unequal symbols is found."""
        return self.chunks * (self.errors + 1) - 1


class WordHashes(dict):
    """64-bit hashes of words, each worked out once; bounded, as it is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles: lower-cased A-Z, words between ASCII white space.

    Fewer words than k are one shingle; no text or no words: none.
    """
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, n)
    k = min(k, n)
    acc = h[: n - k + 1] + np.uint64(k)
    for i in range(1, k):
        acc = mix(acc) + h[i : n - k + 1 + i]
    return np.unique(mix(acc))


def set_name(items: np.ndarray) -> int | None:
    """A 64-bit name of a set; equal sets have equal names."""
    return xxhash.xxh64_intdigest(items.tobytes()) - (1 << 63) if len(items) else None


def signature(items: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = None
    for i in range(0, len(items), 2048):
        x = (items[i : i + 2048, None] * mul + add).min(axis=0)
        low = x if low is None else np.minimum(low, x)
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


def featurize(docs: DataFrame, p: NearDup) -> DataFrame:
    """(doc_id, n_shingles, cls, sig, nib, bits): cls names the set (null for an empty one), sig is its signature, nib 4 bits of each symbol."""

    def run(batches):
        rng = np.random.default_rng(p.seed)
        size = p.chunks * p.width
        mul = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        words = WordHashes()
        for batch in sliced(batches):
            n, cls, sig, nib, bits = [], [], [], [], []
            for text in batch.column("text"):
                items = shingle_set(text.as_py(), p.shingle_words, words)
                n.append(len(items))
                cls.append(set_name(items))
                symbols = signature(items, mul, add) if len(items) else None
                sig.append(None if symbols is None else symbols.tobytes())
                nib.append(None if symbols is None else nibbles(symbols))
                bits.append(None if symbols is None else bitmap(items))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary()), pa.array(nib, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "cls", "sig", "nib", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, cls long, sig binary, nib array<long>, bits array<long>")


def kept_symbols(p: NearDup) -> list[list[int]]:
    """The symbols of a chunk that remain, for each choice of error positions."""
    return [[i for i in range(p.width) if i not in out] for out in combinations(range(p.width), p.errors)]


def slot_mask(p: NearDup) -> int:
    """The low bits of a key, which number its index."""
    return (1 << (p.chunks * math.comb(p.width, p.errors) - 1).bit_length()) - 1


def meet_before(x: Column, y: Column, slot: Column, p: NearDup) -> Column:
    """Whether two sets with the signatures ``x`` and ``y`` meet in an index below ``slot`` too."""
    slots = F.array(*[F.array(*[F.lit(2 * (c * p.width + i) + 1) for i in at]) for c in range(p.chunks) for at in kept_symbols(p)])
    same = lambda i: F.substring(x, i, F.lit(2)) == F.substring(y, i, F.lit(2))
    return F.exists(F.slice(slots, F.lit(1), slot), lambda at: F.forall(at, same))


def index_entries(classes: DataFrame, p: NearDup) -> DataFrame:
    """(key, cls, n): the entries of every set in the indices of all chunks and error positions; a key ends in its index's number."""
    kept = kept_symbols(p)
    low = np.uint64(slot_mask(p))

    def run(batches):
        for batch in sliced(batches):
            sym = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, p.chunks, p.width).astype(np.uint64)
            keys = np.empty((batch.num_rows, p.chunks, len(kept)), np.uint64)
            for j, at in enumerate(kept):
                salt = np.arange(p.chunks, dtype=np.uint64) * np.uint64(len(kept)) + np.uint64(j + 1)
                acc = np.broadcast_to(mix(salt), (batch.num_rows, p.chunks))
                for i in at:
                    acc = mix(acc + sym[:, :, i])
                keys[:, :, j] = acc & ~low | np.arange(p.chunks, dtype=np.uint64) * np.uint64(len(kept)) + np.uint64(j)
            each = p.chunks * len(kept)
            cls = batch.column("cls").to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            flat = keys.reshape(-1).view(np.int64)
            for i in range(0, len(flat), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(flat[i : i + 200_000]), pa.array(np.repeat(cls, each)[i : i + 200_000]), pa.array(np.repeat(n, each)[i : i + 200_000])], ["key", "cls", "n"])

    return classes.select("cls", "n", "sig").mapInArrow(run, "key long, cls long, n long")


def sets_of(docs: DataFrame, wanted: DataFrame, p: NearDup) -> DataFrame:
    """(cls, items): the full sets of the classes in ``wanted`` (doc_id, cls).

    A class is read by a doc_id that has it; those which only rows without a doc_id have, by all such rows.
    """

    def run(batches):
        words = WordHashes()
        for batch in sliced(batches, 200):
            items = [shingle_set(t.as_py(), p.shingle_words, words).view(np.int64) for t in batch.column("text")]
            cls = pa.array([set_name(x) for x in items], pa.int64())
            at = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32)
            flat = np.concatenate(items) if items else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([cls, pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["cls", "items"])

    found = lambda texts: texts.select("text").mapInArrow(run, "cls long, items array<long>").where("cls is not null")
    docs = docs.select("doc_id", "text")
    named = found(docs.join(wanted.select("doc_id").distinct(), "doc_id"))
    nameless = found(docs.where("doc_id is null")).join(wanted.where("doc_id is null").select("cls"), "cls", "left_semi")
    return named.unionByName(nameless).dropDuplicates(["cls"])


def rare_prefixes(sets: DataFrame, percent: int, core: int = CORE) -> DataFrame:
    """(item, cls, side): names under which any two of the sets (cls, items) that are similar enough meet.

    side is 0 for partners of the set's own size band, -1 where those under the name are larger, 1 where they are
    smaller: only sets of side 0, or of -1 and 1, are to be paired.

    Items that more than ``core`` sets have, as those of a template, are the core; the others are a set's own. Sizes are
    cut into bands. A set of size n that is similar to one of a band shares at least ``o = percent / (100 + percent) *
    (n + the band's least size)`` items with it, so of its own items at least ``o`` less its core items. By the rarity of
    items, the first ``own - that + 1`` of its own ones have one that both share: it is entered under these, with the two
    bands. Where its core alone could make it similar, it is entered under all its own items, for partners of which that
    is not so, and apart from these under the first ``n - o + 1`` of all its items, for partners of which it is. So pages
    of one template don't meet by the template, unless that makes them alike; and no item of their own brings more than
    ``core`` sets together. Items of one set alone stand first and join with nothing; they are only counted.
    """
    items = sets.select("cls", F.explode("items").alias("item"))
    shared = items.groupBy("item").agg(F.count("*").alias("sets")).where("sets > 1")
    by = F.sort_array(F.collect_list(F.struct("sets", "item")))
    x = items.join(shared, "item").groupBy("cls").agg(by.alias("by")).join(sets.select("cls", F.size("items").alias("n")), "cls")
    x = x.withColumn("c", F.size(F.filter("by", lambda i: i["sets"] > core))).withColumn("few", F.size("by") - F.col("c"))
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")
    least = F.ceil(F.col("n") * percent / 100)
    x = x.withColumn("own", band(F.col("n"))).withColumn("k", F.explode(F.sequence(band(least), band(F.floor(F.col("n") * 100 / percent)))))
    # a band's least size, a little low rather than high
    partner = F.greatest(least, F.floor(F.pow(F.lit(BAND), F.col("k") - 1e-9)).cast("long"))
    x = x.withColumn("o", F.ceil((F.col("n") + partner) * percent / (100 + percent) - 1e-9).cast("int")).withColumn("need", F.col("o") - F.col("c"))
    alone = F.col("n") - F.size("by")  # own items that no other set has
    firsts = F.when(F.col("need") >= 1, F.col("n") - F.col("c") - F.col("need") + 1 - alone).otherwise(F.col("few"))
    under = lambda kind, count: F.transform(F.slice("by", F.lit(1), F.greatest(F.lit(0), count)), lambda i: F.xxhash64(i["item"], F.least("own", "k"), F.greatest("own", "k"), F.lit(kind)))
    entered = F.concat(under(0, F.least(firsts, F.col("few"))), F.when(F.col("need") < 1, under(1, F.col("n") - F.col("o") + 1 - alone)).otherwise(F.array().cast("array<bigint>")))
    side = F.signum(F.col("own") - F.col("k")).cast("int")
    return x.select(F.explode(F.array_distinct(entered)).alias("item"), "cls", side.alias("side"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, any others) whose sets share at least ``percent`` of their union."""
    x = pairs.join(sets.select(F.col("cls").alias("b"), F.col("items").alias("bs")), "b").join(sets.select(F.col("cls").alias("a"), F.col("items").alias("as")), "a")
    both = F.size(F.array_intersect("as", "bs"))
    return x.where(100 * both >= percent * (F.size("as") + F.size("bs") - both)).select(*pairs.columns)


def nibbles(sig: np.ndarray) -> list[int]:
    """The low 4 bits of each symbol, 16 to a 64-bit integer."""
    four = np.zeros(-(-len(sig) // 16) * 16, np.uint64)
    four[: len(sig)] = sig & 15
    return (four.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def bitmap(items: np.ndarray) -> list[int]:
    """BITS bits; each item sets one."""
    bits = np.zeros(BITS, np.uint8)
    bits[(items >> np.uint64(40)) % np.uint64(BITS)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def may_link(x: dict[str, Column], y: dict[str, Column], percent: int) -> Column:
    """Whether two sets (n, spare, bits) can be similar enough by their sizes and bitmaps: never false for a pair that is.

    A bit of one set alone stands for an item that the other lacks, so a set has at most its size less
    its own bits in common with the other: ``spare``, its size less its bits, and the bits of both.
    """
    both = F.aggregate(F.zip_with(x["bits"], y["bits"], lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda n, b: n + b)
    most = F.least(x["spare"], y["spare"]) + both
    return (100 + percent) * most >= percent * (x["n"] + y["n"])


def near(x: Column, y: Column, p: NearDup) -> Column:
    """Whether two signatures may be within the distance, by 4 bits of each symbol: never false for a pair that is."""
    unequal = F.lit(0)
    for i in range(-(-p.chunks * p.width // 16)):
        v = x[i].bitwiseXOR(y[i])
        v = v.bitwiseOR(F.shiftrightunsigned(v, 2))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 1))
        unequal += F.bit_count(v.bitwiseAND(F.lit(0x1111111111111111)))
    return unequal <= p.max_distance


def merged(roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(cls, root) after ``links`` (ra, rb) between roots."""
    to = connected_components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return written(roots.join(to, "root", "left").select("cls", F.coalesce("to", "root").alias("root")), name)


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, any others).

    Equal sets are one class, which stands in the join once. Classes that meet under a key are first
    held against the key's smallest class. Where a key then still has several components, its members
    are held against one and then four members picked by a hash that differs by key; last, every pair
    across the components that are left, within the signature distance and of sizes and bitmaps that
    allow the similarity. So a large group of copies costs a few stars, and no link between components is lost.
    Under keys that still have over ALL_PAIRS components, as with pages of one template, those pairs are sought
    by the rarest shingles of the members, which every similar enough pair shares: exact, without all pairs.
    A pair may share many keys; in that last step only the one of the lowest index brings it.

    Null, empty and blank texts have no shingles and stay alone. A null doc_id keeps its row and links as
    others do; its component is the smallest doc_id of its component's rows if there is one, else null, and
    it is never kept. Repeated rows give repeated rows; an empty table gives none; other columns are not read.
    """
    small_batches(docs)
    feats = written(featurize(docs, p), "minhash-features")
    classes = feats.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("nib").alias("nib"), F.first("bits").alias("bits"))
    classes = written(classes, "minhash-classes")
    entries = index_entries(classes, p)
    keys = entries.groupBy("key").agg(F.min("cls").alias("head"), F.max("cls").alias("tail")).where("head != tail").drop("tail")
    met = written(entries.join(keys, "key"), "minhash-met")

    brief = classes.select("cls", "n", "nib", "bits", "sig", (F.col("n") - F.aggregate("bits", F.lit(0), lambda k, b: k + F.bit_count(b))).alias("spare"))
    of_row = lambda at: {c: F.col(f"{at}.{c}") for c in ("n", "spare", "bits")}
    star = met.where("cls != head").select("cls", "head").distinct().alias("m").join(brief.alias("x"), F.col("m.cls") == F.col("x.cls")).join(brief.alias("y"), F.col("m.head") == F.col("y.cls"))
    star = star.where(near(F.col("x.nib"), F.col("y.nib"), p) & may_link(of_row("x"), of_row("y"), p.percent)).select(F.col("y.cls").alias("a"), F.col("x.cls").alias("b"), F.col("y.cls").alias("ra"), F.col("x.cls").alias("rb"))
    members = written(met.select("cls").distinct(), "minhash-members")
    sets = written(sets_of(docs, members.join(classes.select("cls", F.col("rep").alias("doc_id")), "cls"), p), "minhash-sets")
    roots = merged(members.select("cls", F.col("cls").alias("root")), confirmed(star, sets, p.percent), "minhash-roots-0")

    open_ = met.select("key", "cls", "n")
    for i, picks in enumerate((1, 4, 0)):
        # what stands under keys that have several components
        g = open_.select("key", "cls", "n").join(roots, "cls")
        mixed = g.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
        open_ = written(g.join(mixed, "key").join(brief.drop("n", *["sig"][: picks]), "cls"), f"minhash-open-{i}")
        x = open_.alias("x")
        if picks:
            of = lambda r: F.min(F.struct(F.xxhash64("key", "cls", F.lit(100 * i + r)).alias("h"), "cls", "n", "root", "nib", "spare", "bits"))  # noqa: E731, B023
            y = open_.groupBy("key").agg(F.array(*[of(r) for r in range(picks)]).alias("picked")).select("key", F.explode(F.array_distinct("picked")).alias("y")).select("key", "y.cls", "y.n", "y.root", "y.nib", "y.spare", "y.bits").alias("y")
            order = F.col("x.cls") != F.col("y.cls")
        else:
            slot = F.col("key").bitwiseAND(F.lit(slot_mask(p))).cast("int")
            many = open_.groupBy("key").agg(F.count_distinct("root").alias("roots")).where(F.col("roots") > ALL_PAIRS).select("key")
            crowd = written(open_.join(many, "key"), "minhash-crowd")
            if not crowd.isEmpty():
                firsts = rare_prefixes(sets.join(crowd.select("cls").distinct(), "cls", "left_semi"), p.percent)
                # the keys of the crowded members are their rare shingles from here on
                firsts = firsts.join(crowd.dropDuplicates(["cls"]).drop("key"), "cls").select(F.col("item").alias("key"), "side", F.lit(0).alias("slot"), *[c for c in open_.columns if c != "key"])
                rest = open_.join(crowd.select("key").distinct(), "key", "left_anti").withColumn("side", F.lit(0)).withColumn("slot", slot)
                open_ = written(rest.unionByName(firsts), "minhash-pairs")
            sides = open_ if "side" in open_.columns else open_.withColumn("side", F.lit(0)).withColumn("slot", slot)
            x, y = sides.where("side <= 0").alias("x"), sides.where("side >= 0").alias("y")
            order = (F.col("x.side") < F.col("y.side")) & (F.col("x.cls") != F.col("y.cls")) | (F.col("x.side") == F.col("y.side")) & (F.col("x.cls") < F.col("y.cls"))
        close = order & (F.col("x.root") != F.col("y.root")) & near(F.col("x.nib"), F.col("y.nib"), p) & may_link(of_row("x"), of_row("y"), p.percent)
        if not picks:
            close = close & ~meet_before(F.col("x.sig"), F.col("y.sig"), F.col("x.slot"), p)
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & close).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"), F.least("x.root", "y.root").alias("ra"), F.greatest("x.root", "y.root").alias("rb")).distinct()
        roots = merged(roots, confirmed(pairs, sets, p.percent), f"minhash-roots-{i + 1}")

    named = written(classes.select("cls", "rep").join(roots, "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root")), "minhash-named")
    ids = named.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = named.join(ids, "root").select("cls", "component")
    out = feats.select("doc_id", "n_shingles", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
