"""A training corpus pipeline over ``documents``: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depquarry.llm import bpe, toxicity
from depquarry.llm.common import table, written
from depquarry.llm.decontam import decontaminate
from depquarry.llm.minhash import NearDup, near_duplicates
from depquarry.llm.queries import tokenizer_file


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below their language's threshold; the classifier learns from all of ``labels``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, model).where(~toxicity.by_language(model)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, by shingles of five words: that with the smallest doc_id.

    Rows without a doc_id can't be told apart by it and all stay; rows that repeat a kept doc_id stay with it.
    """
    kept = near_duplicates(docs, NearDup()).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten consecutive words of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): token ids as unsigned 32-bit, little-endian, and the text that they decode to."""
    path = tokenizer_file("word_bpe_49k.json")
    both = bpe.encode(docs, path, decoded=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.col("text").alias("decoded"))


STAGES = [("toxicity", reject_toxic), ("near_dedup", near_dedup), ("decontamination", reject_contaminated), ("bpe", encode)]

#: Classifier, near-duplicate classes at five words and token ids are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        if i:
            docs = written(docs, f"pipeline-{STAGES[i - 1][0]}")
        docs = stage(spark, docs, sf_dir)
    return docs
