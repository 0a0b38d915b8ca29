"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depquarry.llm.common import checkpoint_root, passing_shuffles


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``links`` (a, b); root is the smallest node reachable.

    Null ends, self-links and repeated links don't matter; no links give no rows. Each round is two
    aggregations with map-side combine and joins on the node, whose large groups adaptive execution
    splits; checkpoint() cuts the lineage, so a lost executor costs a round at most, and a round's
    shuffles are deleted when it ends.
    """
    checkpoint_root(links.sparkSession)
    pair = F.col("a") != F.col("b")
    with passing_shuffles(links.sparkSession):
        edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(pair).distinct().checkpoint()
        before = None
        for _ in range(max_rounds):
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(pair).distinct()
            least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
            small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where(pair)
            edges = small.distinct().checkpoint()
            now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40)))).first())
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    stars = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
