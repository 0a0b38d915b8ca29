"""Inclusion proofs of Merkle trees: authentication paths for every leaf, and their check as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depquarry.operators.graph import _checkpoints
from depquarry.operators.rollup import _beside, placed_in


def leaf_hash(data: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("00")), data.cast("binary")), 256))


def node_hash(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("01")), left, right), 256))


#: Leaves of a block, whose tree is worked out in one row, and the levels of that tree.
BLOCK, LEVELS = 256, 8


def _risen(nodes: Column) -> Column:
    """The level above ``nodes``: neighbours are joined, and a last one without a neighbour rises as it is."""
    pair = lambda k: F.when(2 * k + 1 < F.size(nodes), node_hash(F.get(nodes, 2 * k), F.get(nodes, 2 * k + 1))).otherwise(F.get(nodes, 2 * k))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), pair)


def proofs(leaves: DataFrame, keys: list[str], position: str, data: Column) -> DataFrame:
    """(keys, position, index, size, siblings, root): for each leaf what proves that it is in its group's tree.

    index counts from 0 in the order of ``position``, unique in a group; siblings are the hashes (binary) that
    the leaf's hash is joined with on its way to the root, from the leaf upward. Going up, BLOCK nodes that follow
    one another meet in one row, which keeps all levels of their tree; the blocks' roots are the nodes of the next
    round. Going down, each node of a block gets its siblings there before the path of the block's root. A block
    starts at a multiple of its size, so its tree is part of the group's; a lost executor costs a round, as each
    is checkpointed.
    """
    _checkpoints(leaves.sparkSession)
    x = leaves.select(*keys, F.col(position).alias("_at"), leaf_hash(data).alias("_h"))
    x = placed_in(x, keys, "_at").select(*keys, (F.col("place") - 1).alias("_i"), "_h", "_at", F.lit(1).cast("long").alias("_n"))
    rounds = []
    while not rounds or most:  # the last block of the largest group
        kept = [c for c in x.columns if c == "_at"]
        g = x.groupBy(*keys, F.floor(F.col("_i") / BLOCK).alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_i", "_h", *kept))).alias("_in"), F.sum("_n").alias("_n"))
        tree = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array("_in._h"), lambda t, _: F.concat(t, F.array(_risen(F.element_at(t, -1)))))
        g = g.select(*keys, "_b", "_n", *[F.col("_in._at").alias(c) for c in kept], tree.alias("_tree")).checkpoint()
        rounds.append(g)
        x = g.select(*keys, F.col("_b").alias("_i"), F.element_at("_tree", -1)[0].alias("_h"), "_n")
        most = g.agg(F.max("_b")).first()[0]
    paths = None
    for g in reversed(rounds):
        if paths is None:  # a group is one block here
            g = g.withColumn("root", F.element_at("_tree", -1)[0]).withColumn("size", F.col("_n")).withColumn("siblings", F.array().cast("array<binary>"))
        else:
            g = _beside(g, paths.withColumnRenamed("_i", "_b"), [*keys, "_b"])
        ats = [c for c in g.columns if c == "_at"]
        other = lambda i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda l: F.get(F.get("_tree", l), F.call_function("shiftright", i, l).bitwiseXOR(F.lit(1)))), lambda h: h.isNotNull())
        one = F.transform(F.get("_tree", 0), lambda _, i: F.struct((F.col("_b") * BLOCK + i).alias("_i"), F.concat(other(i), "siblings").alias("siblings"), *[F.get(c, i).alias(c) for c in ats]))
        paths = g.select(*keys, "root", "size", F.explode(one).alias("_c")).select(*keys, "root", "size", "_c.*")
    return paths.select(*keys, F.col("_at").alias(position), F.col("_i").alias("index"), "size", "siblings", F.lower(F.hex("root")).alias("root"))


def proven(data: Column, index: Column, size: Column, siblings: Column, root: Column) -> Column:
    """Whether ``siblings`` lead from the leaf of ``data`` at ``index`` of ``size`` to ``root`` (hexadecimal); false for a null argument.

    The index decides at each level which side the leaf's branch is on, so a proof holds for one place alone;
    too few and too many siblings fail.
    """
    shift = lambda x, n: F.call_function("shiftright", x, n)

    def step(a: Column, sibling: Column) -> Column:
        odd = a["fn"] % 2 == 1
        right = odd | (a["fn"] == a["sn"])
        # a last node without a neighbour has risen over all levels at which its place is even
        rise = F.when(right & ~odd, F.bit_count(a["fn"].bitwiseAND(-a["fn"]) - 1)).otherwise(0) + 1
        h = F.when(right, node_hash(sibling, a["h"])).otherwise(node_hash(a["h"], sibling))
        return F.struct(shift(a["fn"], rise).alias("fn"), shift(a["sn"], rise).alias("sn"), h.alias("h"), (a["ok"] & (a["sn"] > 0)).alias("ok"))

    first = F.struct(index.cast("long").alias("fn"), (size - 1).cast("long").alias("sn"), leaf_hash(data).alias("h"), ((index >= 0) & (index < size)).alias("ok"))
    return F.coalesce(F.aggregate(siblings, first, step, lambda a: a["ok"] & (a["sn"] == 0) & (F.lower(F.hex(a["h"])) == F.lower(root))), F.lit(False))
