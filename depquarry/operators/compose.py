"""Composition: which of many generations of a record is served, and whether they conflict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rungs of a call graph's completeness, the fuller the higher.
COMPLETENESS = ("Unknown", "Failed", "MetadataOnly", "TypeOnly", "BuiltWithBodies")


def rank_of(value: Column, order: Sequence[str]) -> Column:
    """A value's place in an ascending list; others stand below all."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), value), F.lit(0)).cast("int")


def served(df: DataFrame, keys: Sequence[str], ranking: Sequence[Column], identity: Column | None = None, content: Column | None = None, top: Column | None = None) -> DataFrame:
    """One row per key: the first by ``ranking``, with ``generations`` and ``conflict``.

    ``conflict`` is ``identity`` if the key's rows state more than one identity; else ``content`` if
    those of the best ``top`` rank state more than one content; else null. Null and empty values
    state nothing. Conflicting rows are marked, never dropped. The ranking must end in a unique column
    for a defined result.
    """
    w = Window.partitionBy(*keys)
    states = lambda c: F.when(c != "", c)
    out = df.withColumn("generations", F.count("*").over(w))
    out = out.withColumn("_ids", F.size(F.collect_set(states(identity)).over(w)) if identity is not None else F.lit(0))
    if content is not None:
        best = (F.max(top).over(w) == top) if top is not None else F.lit(True)
        out = out.withColumn("_best", best)
        out = out.withColumn("_contents", F.size(F.collect_set(F.when(F.col("_best"), states(content))).over(w))).drop("_best")
    else:
        out = out.withColumn("_contents", F.lit(0))
    out = out.withColumn("conflict", F.when(F.col("_ids") > 1, "identity").when(F.col("_contents") > 1, "content"))
    first = F.row_number().over(w.orderBy(*ranking))
    return out.withColumn("_n", first).where("_n = 1").drop("_n", "_ids", "_contents")


def identified_or_all(df: DataFrame, keys: Sequence[str], identity: Column) -> DataFrame:
    """Rows that name an artefact identity, for keys where any does; else all rows."""
    named = F.coalesce(identity != "", F.lit(False))
    any_named = F.max(named).over(Window.partitionBy(*keys))
    return df.withColumn("_keep", named | ~any_named).where("_keep").drop("_keep")


def preferred_group(df: DataFrame, keys: Sequence[str], preference: Column) -> DataFrame:
    """Rows of the highest preference that the key has (as zip before tree, download before local)."""
    return df.withColumn("_p", preference).withColumn("_m", F.max("_p").over(Window.partitionBy(*keys))).where("_p = _m").drop("_p", "_m")


def pinned_or_served(candidates: DataFrame, keys: Sequence[str], wanted: Column, content: Column, ranking: Sequence[Column]) -> DataFrame:
    """The row whose content hash is the wanted one, else the first by ``ranking``; ``pinned`` tells which."""
    hit = F.coalesce(wanted == content, F.lit(False))
    w = Window.partitionBy(*keys).orderBy(hit.desc(), *ranking)
    return candidates.withColumn("pinned", hit).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_with_ties(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The newest rows of each key, all of them where the newest time is shared."""
    return df.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.col(at).desc()))).where("_r = 1").drop("_r")


def call_graph_ranking(source: Column, completeness: Column, at: Column, content_hash: Column) -> list[Column]:
    """A zip before a tree, then the fuller graph, the newer one, and the smaller hash."""
    return [F.when(source == "zip", 1).otherwise(0).desc(), rank_of(completeness, COMPLETENESS).desc(), at.desc(), content_hash.asc()]


def vulnerability_ranking(findings: Column, coverage: Column, rung: Column, snapshot_at: Column, snapshot: Column, at: Column, content_hash: Column) -> list[Column]:
    """A record that reports an advisory first, then an analysed one, the fuller graph, the newer snapshot and scan."""
    return [findings.isin("Affected", "Withdrawn").desc(), (coverage == "Analysed").desc(), rung.desc(), snapshot_at.desc(), snapshot.desc(), at.desc(), content_hash.asc()]


def interface_ranking(status: Column, at: Column, content_hash: Column) -> list[Column]:
    return [rank_of(status, ("Partial", "Extracted")).desc(), at.desc(), content_hash.asc()]


def licence_ranking(confidence: Column, at: Column, content_hash: Column) -> list[Column]:
    return [confidence.desc_nulls_last(), at.desc(), content_hash.asc()]


def fetch_ranking(lookup_failed: Column, manifest_only: Column, strength: Column, schema: Column, at: Column, content_hash: Column) -> list[Column]:
    """Cacheable facts first, full artefacts before manifests, the stronger verification, the newer schema and time."""
    order = ("unverified", "local", "go.sum", "checksum db", "cross-verified")
    return [lookup_failed.asc(), manifest_only.asc(), rank_of(strength, order).desc(), schema.desc(), at.desc(), content_hash.asc()]
