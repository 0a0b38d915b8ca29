"""Stored records: compressed JSON payloads whose edges lie in a table of their own, put together and verified.

A payload is a zstandard frame, or plain JSON as older writers left it. It embeds the content hash of the
whole record, edges included, but doesn't hold the edges. Reading skips records of another schema version,
holds the embedded hash against the stored one, puts the edges back in their order and hashes again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from depquarry.functions.text import canonical_hash

#: Fixed value: the first bytes of a zstandard frame.
MAGIC = bytes.fromhex("28b52ffd")

VERSION, HASH = "schema_version", "content_hash"


@F.pandas_udf(BinaryType())
def compressed(payload: pd.Series) -> pd.Series:
    """Zstandard frames of binary payloads."""
    import zstandard

    c = zstandard.ZstdCompressor(level=19)
    return payload.map(lambda b: None if b is None else c.compress(b))


@F.pandas_udf(BinaryType())
def decompressed(blob: pd.Series) -> pd.Series:
    """What a blob holds: itself where it is no zstandard frame, null where the frame is torn or broken."""
    import zstandard

    z = zstandard.ZstdDecompressor()

    def of(b):
        if b is None or b[:4] != MAGIC:
            return b
        d = z.decompressobj()
        try:
            out = d.decompress(b)
        except zstandard.ZstdError:
            return None
        return out if d.eof else None

    return blob.map(of)


def ordered_edges(edges: DataFrame, record: str, order: list[str]) -> DataFrame:
    """(record, edges): the edges of each record as an array of their other columns, in the order of ``order``."""
    rest = [c for c in edges.columns if c not in (record, *order)]
    return edges.groupBy(record).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("edges"))


def content_hash(fields: list[Column], edges: Column) -> Column:
    """The hash that a record embeds: of its fields, in the order given, and its edges."""
    # never null, and said so: a join on it else works it out once more to leave nulls out
    return F.coalesce(canonical_hash(F.struct(*fields, edges.alias("edges"))), F.lit(""))


def encode_records(records: DataFrame, keys: list[str], fields: list[str], edges: DataFrame, record: str, order: list[str], version: int) -> tuple[DataFrame, DataFrame]:
    """What a store keeps of ``records`` (keys, fields) and ``edges`` (record, others), whose ``record`` is the record's single key.

    Returns (keys, blob, stored_hash) and the edges under the hash of their record, as record_hash. A record
    without edges has an empty list of them. Two records of the same content have the same hash, and their
    edges are stored once.
    """
    of = ordered_edges(edges, record, order)
    x = records.join(of.withColumnRenamed(record, keys[0]), keys[0], "left")
    kind = of.schema["edges"].dataType
    x = x.withColumn("edges", F.coalesce("edges", F.array().cast(kind)))
    x = x.withColumn(HASH, content_hash([F.col(f) for f in fields], F.col("edges")))
    payload = F.to_json(F.struct(F.lit(version).alias(VERSION), HASH, *fields), {"ignoreNullFields": "false"})
    stored = x.select(*keys, compressed(payload.cast("binary")).alias("blob"), F.col(HASH).alias("stored_hash"))
    kept = x.select(F.col(HASH).alias("record_hash"), "edges").dropDuplicates(["record_hash"])
    return stored, kept.select("record_hash", F.explode("edges").alias("_e")).select("record_hash", "_e.*")


def decode_records(stored: DataFrame, keys: list[str], fields: str, edges: DataFrame, order: list[str], version: int) -> DataFrame:
    """(keys, record, edges, reason) for every row of ``stored`` (keys, blob, stored_hash); ``fields`` is the payload's schema.

    reason is null for a record that is whole, and else the first that holds: ``no payload``, ``torn`` (it
    can't be decompressed), ``unreadable`` (no JSON of this shape), ``stale`` (another schema version),
    ``hash differs`` (from the stored one), ``content differs`` (fields and edges hash to another). Only
    whole records come with record and edges. Edges are found by the stored hash, not by the key, as a key
    may have many generations.
    """
    kind = StructType.fromDDL(fields)
    names = [f.name for f in kind]
    x = stored.select(*keys, "stored_hash", F.col("blob").isNull().alias("_none"), decompressed("blob").alias("_raw"))
    text = F.col("_raw").cast("string")
    parsed = F.from_json(text, f"{VERSION} int, {HASH} string, {fields}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    x = x.withColumn("_p", parsed)
    of = ordered_edges(edges, "record_hash", order)
    empty = F.array().cast(of.schema["edges"].dataType)
    x = x.join(of.withColumnRenamed("record_hash", "stored_hash"), "stored_hash", "left").withColumn("edges", F.coalesce("edges", empty))
    again = content_hash([F.col(f"_p.{n}").alias(n) for n in names], F.col("edges"))
    p = lambda n: F.col(f"_p.{n}")
    reason = (
        F.when(F.col("_none"), "no payload").when(F.col("_raw").isNull(), "torn").when(F.col("_p").isNull() | p("_broken").isNotNull() | p(VERSION).isNull(), "unreadable")
        .when(p(VERSION) != version, "stale").when(~F.coalesce(p(HASH) == F.col("stored_hash"), F.lit(False)), "hash differs").when(again != p(HASH), "content differs")
    )
    x = x.withColumn("reason", reason)
    whole = F.col("reason").isNull()
    return x.select(*keys, F.when(whole, F.struct(*[p(n).alias(n) for n in names])).alias("record"), F.when(whole, F.col("edges")).alias("edges"), "reason")
