"""Advisories in the OSV JSON form: documents to range events and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "id string, withdrawn string, affected array<struct<package:struct<name:string,ecosystem:string>,"
    "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>,"
    "ecosystem_specific:struct<imports:array<struct<path:string,symbols:array<string>>>>>>"
)


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """(id, withdrawn, affected) from a folder with a JSON document per file."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def range_events(advisories: DataFrame) -> DataFrame:
    """(id, path, range_no, position, kind, version) of SEMVER ranges; other kinds of range are left out."""
    a = advisories.select("id", F.explode("affected").alias("a")).select("id", F.col("a.package.name").alias("path"), F.posexplode("a.ranges").alias("range_no", "r")).where("r.type = 'SEMVER'")
    e = a.select("id", "path", "range_no", F.posexplode("r.events").alias("position", "e"))
    return e.select("id", "path", "range_no", "position", F.when(F.col("e.introduced").isNotNull(), "introduced").otherwise("fixed").alias("kind"), F.coalesce("e.introduced", "e.fixed").alias("version"))


def named(advisories: DataFrame) -> DataFrame:
    """(id, path, withdrawn, symbols): each module an advisory names, with its symbols, distinct and sorted."""
    a = advisories.select("id", F.col("withdrawn").isNotNull().alias("withdrawn"), F.explode("affected").alias("a"))
    symbols = F.flatten(F.transform(F.coalesce("a.ecosystem_specific.imports", F.array()), lambda i: F.coalesce(i.symbols, F.array())))
    return a.select("id", F.col("a.package.name").alias("path"), "withdrawn", F.array_sort(F.array_distinct(symbols)).alias("symbols"))


def index_entries(index: DataFrame, path: str, document: str) -> DataFrame:
    """(path, id, fixed) from the index's rows: a module's path and a JSON list of its advisories; an unfixed one has an empty version."""
    e = index.select(F.col(path).alias("path"), F.explode(F.from_json(document, "array<struct<id string, fixed string>>")).alias("e"))
    return e.select("path", "e.id", F.coalesce("e.fixed", F.lit("")).alias("fixed"))
