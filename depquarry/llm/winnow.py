"""Document fingerprints by winnowing, with DataFrame functions alone.

Fingerprints are of the grams that start at every code point of the text without white space: a gram
is ``SPAN`` code points; of each ``REACH`` consecutive grams the one with the smallest hash is kept,
the rightmost of equals, with its position. Two texts that share ``REACH + SPAN - 1`` consecutive code
points other than white space so share a kept hash, wherever the passage stands. A shorter text is one
gram; one of fewer grams, one window.

:func:`kept_grams` is the coarse form: its units are runs of at most ``UNIT`` code points, a gram is
``GRAM`` units with a rolling polynomial hash, a window ``WINDOW`` grams. Its units, and so what it
promises, are aligned anew at white space only.

A kept gram is one number: its 31-bit hash above, and below the complement of its position in 32
bits, so the smallest number of a window is the rightmost of the smallest hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depquarry.llm.common import order_bounds, range_bucket, shuffle_partitions, small_batches

SPAN, REACH = 16, 32
#: Code points on one side of a joint that windows across it can hold.
EDGE = SPAN + REACH - 2
UNIT, GRAM, WINDOW = 4, 4, 8
PRIME, BASE = (1 << 31) - 1, 1_000_003


def doubled(x: Column, size: int, join) -> Column:
    """Each run of ``size`` (a power of two) neighbours in one value, by joining halves; the last size - 1 have none."""
    step = 1
    while step < size:
        # by way of an array of one, so each round is computed once
        x = F.transform(F.array(x), lambda y: F.zip_with(y, F.slice(y, F.lit(step + 1), F.greatest(F.size(y), F.lit(1))), join(step)))[0]  # noqa: B023
        step *= 2
    return x


def placed(grams: Column, number) -> Column:
    """Grams as numbers: ``number(gram)`` of 31 bits, and the complement of the position."""
    return F.transform(grams, lambda g, i: F.shiftleft(number(g), 32).bitwiseOR(F.lit((1 << 32) - 1) - i))


def window_minima(g: Column, window: int) -> Column:
    """The distinct smallest numbers of each ``window`` (a power of two) consecutive ones; ``g`` is a lambda's variable."""
    n = F.size(g) - (window - 1)
    least = doubled(g, window, lambda _: lambda a, b: F.when(a < b, a).otherwise(b))
    return F.when(n >= 1, F.array_distinct(F.slice(least, F.lit(1), F.greatest(n, F.lit(1))))).otherwise(F.array(F.array_min(g)))


def solid(text: Column) -> Column:
    """The text without ASCII white space."""
    for sign in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(sign), F.lit(""))
    return text


def kept_spans(text: Column) -> Column:
    """The fingerprint of a text by grams at every code point, as array<long>; null, empty and blank texts: empty."""
    def over_solid(s: Column) -> Column:
        grams = F.when(F.char_length(s) < SPAN, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(rf"(?s)(?=(.{{{SPAN}}}))."), F.lit(1)))
        numbers = placed(grams, lambda g: F.shiftrightunsigned(F.xxhash64(g), 33))
        return F.transform(F.array(numbers), lambda g: window_minima(g, REACH))[0]

    return F.transform(F.array(solid(F.coalesce(text, F.lit("")))), lambda s: F.when(s != "", over_solid(s)).otherwise(F.array().cast("array<long>")))[0]


def joined_kept(own: Column, x: Column, after: Column, y: Column, seam: Column) -> Column:
    """The fingerprint of the first ``x`` code points (white space apart) of one text followed by the first ``y`` of another.

    ``own`` and ``after`` are the two texts' fingerprints, ``seam`` the EDGE code points on either side of the
    joint. Windows that lie on one side are those of its text; only those across the joint are taken anew.
    So ``x`` must be at least EDGE + 1; else the joined text is to be fingerprinted itself.
    """

    def upto(kept: Column, n: Column) -> Column:
        def begins(k: Column, i: Column) -> Column:
            """The first window that keeps a gram: that in which it comes in below the one before, or that which the one before has left."""
            before = F.get(kept, i - 1)
            enters = F.shiftrightunsigned(k, 32) <= F.shiftrightunsigned(before, 32)
            return F.when(i == 0, F.lit(0)).when(enters, position(k) - (REACH - 1)).otherwise(position(before) + 1)

        return F.filter(kept, lambda k, i: begins(k, i) < n - EDGE)

    across = F.transform(kept_spans(seam), lambda k: k - (x - EDGE))
    joint = F.array_distinct(F.concat(upto(own, x), across, F.transform(upto(after, y), lambda k: k - x)))
    return F.when(y == 0, upto(own, x)).otherwise(joint)


def kept_grams(text: Column) -> Column:
    """The coarse fingerprint of a text: kept grams in order, as array<long>; null, empty and blank texts: empty."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\S{{1,{UNIT}}}"), F.lit(0))
    hashed = F.transform(units, lambda u: F.shiftrightunsigned(F.xxhash64(u), 34))

    def over_units(u: Column) -> Column:
        n = F.size(u) - (GRAM - 1)
        rolled = doubled(u, GRAM, lambda step: lambda a, b: (a * pow(BASE, step, PRIME) + b) % PRIME)
        grams = F.when(n >= 1, F.slice(rolled, F.lit(1), F.greatest(n, F.lit(1)))).otherwise(
            F.array(F.aggregate(u, F.size(u).cast("long"), lambda a, b: (a * BASE + b) % PRIME)))
        return F.transform(F.array(placed(grams, lambda h: h)), lambda g: window_minima(g, WINDOW))[0]

    return F.transform(F.array(hashed), lambda u: F.when(F.size(u) > 0, over_units(u)).otherwise(F.array().cast("array<long>")))[0]


def position(kept: Column) -> Column:
    return F.lit((1 << 32) - 1) - kept.bitwiseAND(F.lit((1 << 32) - 1))


def positions(kept: Column) -> Column:
    """Where in the text's grams each kept gram stands, from 0."""
    return F.transform(kept, position)


def hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda x: F.shiftrightunsigned(x, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two :func:`hashes` arrays; 1 for two without any."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>`` of the next row by descending doc_id, equal doc_ids by their columns; the first follows the last.

    Rows are dealt to ranges of doc_id. The first row of each range goes to the range before it as
    well, so each range has its last row's follower; no range holds more than its share, unless one
    doc_id does. Null doc_ids come last.
    """
    parts = 2 * shuffle_partitions(docs.sparkSession)
    bounds = order_bounds(docs, "doc_id", parts)
    ranged = docs.withColumn("_range", range_bucket(F.col("doc_id"), bounds))
    order = [F.col("doc_id").desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in columns if c != "doc_id"]]
    # a row for each range that has any: its first row's doc_id, and the range which that row follows
    tops = ranged.groupBy("_range").agg(F.max("doc_id").alias("_top"))
    down = Window.orderBy(F.col("_range").desc())
    prior = F.coalesce(F.lag("_range").over(down), F.min("_range").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ranged = ranged.join(F.broadcast(tops.withColumn("_prior", prior)), "_range")
    first = F.col("doc_id").eqNullSafe(F.col("_top"))
    here = F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy"))
    there = F.struct(F.col("_prior").alias("r"), F.lit(1).alias("copy"))
    both = ranged.withColumn("_at", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here)))).select("*", "_at.*").drop("_at", "_range", "_top", "_prior")
    w = Window.partitionBy("r").orderBy("copy", *order)
    return both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("copy = 0").drop("copy", "r")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the last third of the code points replaced by the first as many of the next
    document's. Null texts count as empty. A fingerprint's string lists its kept grams, hash and position in a
    number each. Repeated rows follow each other; a lone row follows itself; no rows give none. Every text is
    fingerprinted once: an edited one has the grams of its two parts, and new ones where they meet.
    """
    small_batches(docs)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("kept", kept_spans(F.col("text")))
    x = with_next(own, ["text", "kept"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    x = x.select("doc_id", n.cast("long").alias("n_chars"), "kept", "next_kept", F.substring("text", 1, n - third).alias("head"), F.substring("next_text", 1, third).alias("tail"))
    x = x.select("doc_id", "n_chars", "kept", "next_kept", F.concat("head", "tail").alias("edited"), *[solid(F.col(c)).alias(c) for c in ("head", "tail")])
    # lengths as columns, as lambdas work out what they hold for each element
    x = x.select("*", F.char_length("head").alias("x"), F.char_length("tail").alias("y"), F.concat(F.right("head", F.lit(EDGE)), F.left("tail", F.lit(EDGE))).alias("seam"))
    whole = kept_spans(F.when(F.col("x") > EDGE, F.lit("")).otherwise(F.concat("head", "tail")))
    x = x.select("doc_id", "n_chars", "edited", "kept", "next_kept", F.when(F.col("x") > EDGE, joined_kept(*map(F.col, ("kept", "x", "next_kept", "y", "seam")))).otherwise(whole).alias("edited_kept"))
    x = x.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "kept", "edited_kept", hashes(F.col("kept")).alias("a"), hashes(F.col("edited_kept")).alias("b"), hashes(F.col("next_kept")).alias("c"))
    return x.select("doc_id", "n_chars", "edited_sha256", F.col("kept").cast("string").alias("fingerprint"), F.col("edited_kept").cast("string").alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
