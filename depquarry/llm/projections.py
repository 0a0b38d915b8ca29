"""Near-duplicate embeddings: collision counts over one-dimensional projections, verified by their cosine.

Unit vectors are put on ``lines`` random directions. Two vectors collide on a line when one lies in the
window of half-width ``half`` centred on the other. A pair at the threshold collides on each line with a
known probability, so its number of collisions is binomial: pairs with at least the count that all but
one in ``1 / miss`` such pairs reach are verified.

One line alone cannot narrow the search: at the threshold its windows hold a tenth and more of all rows,
whatever their number. So the pairs that are counted are those that meet where several sorted lines are
cut into cells together. The number of lines of such a grid follows the logarithm of the row count, and
that of the grids is the least with which a pair at the threshold meets in all but ``miss`` of cases.

Dense groups, such as near copies of one vector, share most cells. The classes of a cell of the first grid
are ringed by their angle to the cell's mean: where the rings of two add up to less than the threshold's
angle, they are linked by the triangle inequality, so they are counted by a histogram of rings and tied to
one of the innermost ring, and blocks of such pairs are not formed. Other cells are cut into blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depquarry.llm.common import sliced, written
from depquarry.llm.components import connected_components

#: Rings are so wide, in degrees.
RING = 0.25
#: Vectors of a cell in a block; a ring of fewer than a quarter of it has no blocks of its own.
BLOCK = 1000



@dataclass(frozen=True)
class Projections:
    cosine: float = 0.95
    lines: int = 32
    half: float = 0.6
    width: float = 2.0
    per_cell: int = 400
    miss: float = 1e-4
    seed: int = 11

    @property
    def rings(self) -> int:
        """Two vectors are linked for certain when their rings add up to this at most; the rings are counted from 0."""
        return math.floor(math.degrees(math.acos(self.cosine)) / RING - 1e-6) - 2

    def collision(self, cosine: float) -> float:
        """The probability that two vectors of this cosine collide on a line."""
        return math.erf(self.half / math.sqrt(2 - 2 * cosine) / math.sqrt(2))

    def same_cell(self, cosine: float) -> float:
        """The probability that two vectors of this cosine are in one cell of a line that is cut at random."""
        x = self.width / math.sqrt(2 - 2 * cosine)
        return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))

    @property
    def count(self) -> int:
        """The collisions that a pair at the threshold reaches in all but ``miss`` of cases."""
        p, below = self.collision(self.cosine), 0.0
        for k in range(self.lines + 1):
            below += math.comb(self.lines, k) * p**k * (1 - p) ** (self.lines - k)
            if below > self.miss:
                return k
        return self.lines

    def grids(self, rows: int) -> tuple[int, int]:
        """(lines of a grid, grids) for so many rows: about ``per_cell`` vectors without likeness share a cell."""
        deep = max(1, math.ceil(math.log(max(1.0, rows / self.per_cell)) / -math.log(self.same_cell(0.0))))
        return deep, math.ceil(math.log(self.miss) / math.log(1 - self.same_cell(self.cosine) ** deep))


def usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not all zero."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def vectors(batch, name: str):
    """(size, places, matrix) of the vectors of a batch by their size."""
    col = batch.column(name)
    sizes = np.asarray(col.value_lengths())
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        flat = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield int(size), at, flat.reshape(len(at), int(size)).astype(np.float64)


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def projected(classes: DataFrame, p: Projections, deep: int, grids: int) -> DataFrame:
    """(cls, spots, cells): where a class (cls, v) lies on each line, in 64ths of a window, and its cell in each grid."""
    lines, step = p.lines, p.half / 32

    def run(batches):
        known = {}
        for batch in sliced(batches):
            spots, cells = np.empty((batch.num_rows, lines), np.int16), np.empty((batch.num_rows, grids), np.int64)
            for size, at, m in vectors(batch, "v"):
                if size not in known:
                    rng = np.random.default_rng([p.seed, size])
                    known[size] = rng.standard_normal((size, lines + deep * grids)), rng.random(deep * grids) * p.width, rng.integers(1, 1 << 63, (grids, deep), dtype=np.uint64) | np.uint64(1)
                ways, cut, mul = known[size]
                x = unit(m) @ ways
                spots[at] = np.clip(np.rint(x[:, :lines] / step), -32000, 32000)
                grid = np.floor((x[:, lines:] + cut) / p.width).astype(np.int64).astype(np.uint64).reshape(len(at), grids, deep)
                key = (grid * mul).sum(axis=2, dtype=np.uint64) + np.arange(grids, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)
                key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                cells[at] = (key ^ (key >> np.uint64(29))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([s.tobytes() for s in spots], pa.binary()), pa.array(cells.tolist(), pa.list_(pa.int64()))], ["cls", "spots", "cells"])

    return classes.select("cls", "v").mapInArrow(run, "cls long, spots binary, cells array<long>")


def ringed(classes: DataFrame, p: Projections) -> DataFrame:
    """(cls, group, ring): the cell of the first grid, and the ring around the mean direction of its classes (cls, v, group)."""
    most = classes.agg(F.max(F.size("v"))).first()[0] or 0
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    cells = classes.groupBy("group").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("v", F.lit(i)) / norm) for i in range(most)]).alias("mean")).where("n > 1")
    both = classes.join(cells.drop("n"), "group")
    far = p.rings + 1  # certain with nobody

    def run(batches):
        for batch in sliced(batches):
            ring = np.full(batch.num_rows, far, np.int32)
            for size, at, m in vectors(batch, "v"):
                mean = np.array([x[:size] for x in batch.column("mean").take(pa.array(at)).to_pylist()], np.float64)
                long = np.linalg.norm(mean, axis=1)
                cos = np.einsum("ij,ij->i", unit(m), mean) / np.where(long > 0, long, 1)
                ring[at] = np.where(long > 1e-9, np.minimum(far, np.floor(np.degrees(np.arccos(np.clip(cos, -1, 1))) / RING)), far)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("group"), pa.array(ring)], ["cls", "group", "ring"])

    return both.select("cls", "group", "v", "mean").mapInArrow(run, "cls long, group long, ring int")


def blocks(entries: DataFrame, p: Projections) -> DataFrame:
    """``entries`` (key, cls, group, ring, spots) of cells with several classes, as members (pair, side, cls, group, ring, spots) of pairs of blocks.

    side is 0 for the first block of a pair, 1 for the second, 2 where both are one.
    """
    crowds = entries.groupBy("key", "group", "ring").agg(F.count("*").alias("n"))
    own = (F.col("n") >= BLOCK // 4) & (F.col("ring") <= p.rings)
    kinds = crowds.select("key", F.when(own, F.col("group")).alias("g"), F.when(own, F.col("ring")).alias("r"), "n").groupBy("key", "g", "r").agg(F.sum("n").alias("n"))
    kinds = kinds.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    of_key = kinds.groupBy("key").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("key")
    kinds = written(kinds.join(of_key, "key"), "projection-kinds")

    e, k = entries.alias("e"), kinds.alias("k")
    dense = kinds.where("g is not null").select("key", F.col("g").alias("group"), F.col("r").alias("ring"), "parts")
    loose = kinds.where("g is null").select("key", F.col("parts").alias("loose"))
    e = entries.join(dense, ["key", "group", "ring"], "left").join(loose, "key", "left").where("parts is not null or loose is not null")
    own = F.col("parts").isNotNull()
    part = F.pmod(F.xxhash64("cls", "key"), F.coalesce("parts", "loose")).cast("int")
    e = e.select("key", F.when(own, F.col("group")).alias("g"), F.when(own, F.col("ring")).alias("r"), part.alias("part"), "cls", "group", "ring", "spots")

    each = kinds.select("key", "g", "r", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    place = lambda t: F.struct(F.coalesce(f"{t}.g", F.lit(0)), F.coalesce(f"{t}.r", F.lit(-1)), f"{t}.part")
    x, y = each.alias("x"), each.alias("y")
    certain = F.coalesce((F.col("x.g") == F.col("y.g")) & (F.col("x.r") + F.col("y.r") <= p.rings), F.lit(False))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (place("x") <= place("y")) & ~certain)
    same = place("x") == place("y")
    named = F.xxhash64("x.key", "x.g", "x.r", "x.part", "y.g", "y.r", "y.part")
    side = lambda t, s: F.struct(F.col(f"{t}.g").alias("g"), F.col(f"{t}.r").alias("r"), F.col(f"{t}.part").alias("part"), F.lit(s).alias("side"))
    sides = F.when(same, F.array(side("x", 2))).otherwise(F.array(side("x", 0), side("y", 1)))
    seats = pairs.select(F.col("x.key").alias("key"), named.alias("pair"), F.explode(sides).alias("s")).select("key", "pair", "s.*")
    k = seats.alias("k")
    e = e.alias("e")
    at = (F.col("e.key") == F.col("k.key")) & F.col("e.g").eqNullSafe(F.col("k.g")) & F.col("e.r").eqNullSafe(F.col("k.r")) & (F.col("e.part") == F.col("k.part"))
    return e.join(k, at).select("k.pair", "k.side", "e.cls", "e.group", "e.ring", "e.spots")


def collided(members: DataFrame, p: Projections) -> DataFrame:
    """(a, b), a < b: the pairs of classes across the two sides of a pair of blocks that collide on enough lines, but for certain ones."""
    window, least, rings, lines = 32, p.count, p.rings, p.lines

    def run(batches):
        def pairs_of(rows):
            side, cls, group, ring = (np.concatenate([r[i] for r in rows]) for i in range(4))
            spots = np.concatenate([r[4] for r in rows])
            left = np.flatnonzero(side != 1)
            right = left if side[left[:1]].tolist() == [2] else np.flatnonzero(side == 1)
            a, b = [], []
            for i in left:
                hits = (np.abs(spots[right] - spots[i]) <= window).sum(axis=1) >= least
                hits &= ~((group[right] == group[i]) & (ring[right] + ring[i] <= rings))
                hits &= cls[right] > cls[i] if right is left else cls[right] != cls[i]
                found = right[hits]
                a.append(np.minimum(cls[i], cls[found]))
                b.append(np.maximum(cls[i], cls[found]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        held, name = [], None
        for batch in sliced(batches, 10_000):
            pair = batch.column("pair").to_numpy(zero_copy_only=False)
            spots = np.frombuffer(b"".join(batch.column("spots").to_pylist()), np.int16).reshape(-1, lines)
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("side", "cls", "group", "ring")] + [spots]
            cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if held and pair[i] != name:
                    yield from pairs_of(held)
                    held = []
                name = pair[i]
                held.append([c[i:j] for c in cols])
        if held:
            yield from pairs_of(held)

    dealt = members.repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """The pairs (a, b) of classes (cls, v) whose cosine, in double precision, is at least ``cosine``."""

    def run(batches):
        for batch in sliced(batches):
            keep = np.zeros(batch.num_rows, bool)
            x, y = batch.column("x"), batch.column("y")
            same = np.asarray(x.value_lengths()) == np.asarray(y.value_lengths())
            rows = batch.filter(pa.array(same))
            at = np.flatnonzero(same)
            for (_, i, m), (_, _, n) in zip(vectors(rows, "x"), vectors(rows, "y"), strict=True):
                m, n = m / np.abs(m).max(axis=1, keepdims=True), n / np.abs(n).max(axis=1, keepdims=True)
                cos = np.einsum("ij,ij->i", m, n) / (np.linalg.norm(m, axis=1) * np.linalg.norm(n, axis=1))
                keep[at[i]] = cos >= cosine
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    both = pairs.join(classes.select(F.col("cls").alias("a"), F.col("v").alias("x")), "a").join(classes.select(F.col("cls").alias("b"), F.col("v").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_embeddings(rows: DataFrame, p: Projections = Projections()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows`` (vec_id, embedding, any others).

    Vectors are linked when their cosine is at least ``p.cosine``; those of different sizes never are, nor
    are null ones, all-zero ones and those that hold a null or a non-finite component. Equal vectors are one
    class, named by a 64-bit hash, in the search, and link with one another. n_links counts rows. A row
    without a vec_id links as others do; its component is the smallest vec_id that it reaches, else null, and
    it is never kept. Repeated rows give repeated rows, linked with each other; an empty table gives none.
    """
    v = F.col("embedding")
    fit = usable(v)
    named = rows.select("vec_id", F.when(fit, F.xxhash64("embedding")).alias("cls"), F.when(fit, v).alias("v"))
    classes = written(named.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"), F.first("v").alias("v")), "projection-classes")
    deep, grids = p.grids(classes.count())
    places = written(projected(classes, p, deep, grids), "projection-places")

    groups = places.select("cls", F.get("cells", F.lit(0)).alias("group")).join(classes.select("cls", "v", "copies"), "cls")
    rings = written(ringed(groups.drop("copies"), p), "projection-rings")
    far = p.rings + 1
    placed = places.join(rings, "cls", "left").select("cls", "spots", "cells", F.coalesce("group", F.get("cells", F.lit(0))).alias("group"), F.coalesce("ring", F.lit(far)).alias("ring"))
    entries = placed.select(F.explode("cells").alias("key"), "cls", "group", "ring", "spots")
    links = written(verified(collided(blocks(entries, p), p), classes, p.cosine), "projection-links")

    # those that rings link for certain: tied to one of the innermost ring, counted by rings
    near = rings.where(F.col("ring") <= p.rings).join(classes.select("cls", "copies", "rep"), "cls")
    crowd = near.groupBy("group", "ring").agg(F.sum("copies").alias("n"), F.min("cls").alias("first"))
    hub = crowd.groupBy("group").agg(F.min(F.struct("ring", "first")).alias("hub"), F.collect_list(F.struct("ring", "n")).alias("crowd"))
    of = near.join(hub, "group")
    within = F.aggregate(F.filter("crowd", lambda c: c.ring + F.col("ring") <= p.rings), F.lit(0).cast("long"), lambda a, c: a + c.n)
    certain = of.select("cls", (within - F.when(2 * F.col("ring") <= p.rings, F.col("copies")).otherwise(0)).alias("n"))
    ties = of.where((F.col("hub.ring") + F.col("ring") <= p.rings) & (F.col("cls") != F.col("hub.first"))).select(F.col("hub.first").alias("a"), F.col("cls").alias("b"))

    weight = classes.select(F.col("cls").alias("to"), "copies")
    both = links.select(F.col("a").alias("cls"), F.col("b").alias("to")).unionAll(links.select(F.col("b").alias("cls"), F.col("a").alias("to")))
    counts = both.join(weight, "to").select("cls", F.col("copies").alias("n")).unionAll(certain).groupBy("cls").agg(F.sum("n").alias("n"))
    roots = connected_components(links.unionAll(ties))
    of_class = classes.select("cls", "rep", "copies").join(roots, F.col("cls") == F.col("node"), "left").join(counts, "cls", "left")
    of_class = written(of_class.select("cls", "rep", F.coalesce("root", "cls").alias("root"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "projection-classes-linked")
    least = of_class.groupBy("root").agg(F.min("rep").alias("component"))
    told = of_class.join(least, "root").select("cls", "n_links", "component")
    out = named.select("vec_id", "cls").join(told, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
