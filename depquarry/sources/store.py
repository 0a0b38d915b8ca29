"""Tables of a store folder: reads with their schema versions checked, appends, upserts, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depquarry.functions.text import canonical_hash


def open_store(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The Parquet tables of a folder by name, registered as views too."""
    out = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out


def verified(df: DataFrame, row: Column, stored_hash: str, schema_version: str | None = None, current: int | None = None) -> DataFrame:
    """Rows of the current schema version whose content hashes to what was stored."""
    out = df.where(F.concat(F.lit("sha256:"), F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)) == F.col(stored_hash))
    return out.where(F.col(schema_version) == current) if schema_version else out


def append_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` that an idempotent append adds: none whose key is there; of repeated keys the least row, column by column."""
    rest = [c for c in new.columns if c not in keys]
    if rest:
        least = F.min(F.struct(*rest)).alias("_row")
        new = new.groupBy(*keys).agg(least).select(*keys, "_row.*").select(*new.columns)
    else:
        new = new.distinct()
    return new.join(existing.select(*keys), keys, "left_anti")


def append_hashed(existing: DataFrame, new: DataFrame, row: Column) -> DataFrame:
    """The rows of ``new`` whose content hash (of ``row``) is not among the hashes of ``existing``, each content once, with ``hash``."""
    return append_new(existing.withColumn("hash", canonical_hash(row)), new.withColumn("hash", canonical_hash(row)), ["hash"])


def generations(records: DataFrame, key: dict[str, object], order: list[str], newest_first: bool = True) -> DataFrame:
    """The records of one key in the order of ``order``; of a key that is not there, none. A null in ``key`` matches nulls."""
    for column, value in key.items():
        records = records.where(F.col(column).eqNullSafe(F.lit(value)))
    return records.orderBy(*[F.col(c).desc() if newest_first else F.col(c).asc() for c in order])


def existing_of(wanted: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` with ``known``: whether a row of ``known`` has its keys. Null keys are never known."""
    there = known.select(*keys).distinct().withColumn("known", F.lit(True))
    return wanted.join(there, keys, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def reread_json_lines(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as JSON lines and returns the lines (line) as they were written."""
    write_json_lines(df, path)
    return df.sparkSession.read.text(path).select(F.col("value").alias("line"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row per key, the newest by ``at``; of equal times the new one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def write_table(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    w = df.write.mode("append").option("compression", "zstd")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def bill_of_materials(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref, component, depends_on): a row per component (ref, name, version, licence), sorted distinct dependencies.

    ``edges`` (src, dst) by ref; every component has a row, the ones without dependencies an empty list.
    """
    deps = edges.groupBy(F.col("src").alias("ref")).agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))
    c = components.dropDuplicates(["ref"])
    body = F.to_json(F.struct(F.lit("library").alias("type"), "name", "version", F.col("ref").alias("purl"), "licence"))
    return c.join(deps, "ref", "left").select("ref", body.alias("component"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))


def notices(modules: DataFrame, records: DataFrame) -> DataFrame:
    """(path, version, notice, review): the copyrights of each module, or why it must be reviewed; none is left out.

    ``records`` (path, version, status, copyrights array<string>).
    """
    x = modules.select("path", "version").distinct().join(records.select("path", "version", "status", "copyrights"), ["path", "version"], "left")
    review = F.when(F.col("status").isNull(), "no record").when(F.col("status").isin("Ambiguous", "None", "ExtractionFailed"), F.concat(F.lit("licence "), F.col("status"))).when(F.size(F.coalesce("copyrights", F.array().cast("array<string>"))) == 0, "no copyright")
    return x.select("path", "version", F.when(review.isNull(), F.array_join(F.array_sort(F.array_distinct("copyrights")), "\n")).alias("notice"), review.alias("review"))


def source_checksums(wanted: DataFrame, releases: DataFrame) -> DataFrame:
    """(version, filename, sha256, problem): the source file of each wanted release; no such release and no such file are told apart.

    ``releases`` (version, files array<struct<filename, kind, sha256>>).
    """
    source = F.get(F.filter("files", lambda f: f.kind == "source"), F.lit(0))
    x = wanted.select("version").distinct().join(releases.select("version", source.alias("_f"), F.lit(True).alias("_r")), "version", "left")
    return x.select("version", "_f.filename", "_f.sha256", F.when(F.col("_r").isNull(), "release not found").when(F.col("_f").isNull(), "source file missing").alias("problem"))
