import math
import random
from dataclasses import replace

import numpy as np
import pytest

from depquarry.llm import projections
from depquarry.llm.projections import Projections, near_embeddings
from depquarry.llm.queries import op11_embedding_near_dedup


def brute(rows, cosine=0.95):
    """rows (vec_id, vector): (vec_id, n_links, component_id) sorted."""
    usable = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    at = [i for i, (_, v) in enumerate(rows) if usable(v)]
    links = {i: set() for i in range(len(rows))}
    for size in {len(rows[i][1]) for i in at}:
        mine = [i for i in at if len(rows[i][1]) == size]
        m = np.array([rows[i][1] for i in mine], np.float32).astype(np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(m @ m.T >= cosine), strict=True):
            if a != b:
                links[mine[a]].add(mine[b])
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                new = links[todo.pop()] - group
                group |= new
                todo += new
            seen |= group
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            for j in group:
                out[j] = (rows[j][0], len(links[j]), min(ids, default=None))
    return sorted(out, key=str)


def plain(df):
    rows = df.collect()
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in rows)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=str)


def near(rng, v, cosine):
    """A unit vector of this cosine to v."""
    v = v / np.linalg.norm(v)
    w = rng.standard_normal(len(v))
    w -= (w @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def test_query_against_all_pairs(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert plain(op11_embedding_near_dedup(spark, small)) == brute(rows)


@pytest.mark.parametrize("block", [1000, 20])
def test_clusters_chains_and_a_crowd(spark, monkeypatch, block):
    monkeypatch.setattr(projections, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows, vectors = [], [rng.standard_normal(24) for _ in range(300)]
    for c in (0.9999, 0.99, 0.97, 0.955, 0.945, 0.9):
        vectors += [near(rng, v, c) * rng.uniform(0.001, 1000) for v in vectors[:20]]
    crowd = rng.standard_normal(24)
    vectors += [near(rng, crowd, rng.choice([0.999, 0.99, 0.98, 0.97])) for _ in range(300)]
    for _ in range(15):  # a chain
        vectors.append(near(rng, vectors[-1], 0.96))
    vectors += vectors[:5] + [crowd] * 40
    rows = [(i * 7 % 5003, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    got, want = plain(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vec_id long, embedding array<float>, cls int").transform(near_embeddings)), brute(rows)
    assert got == want


def test_vectors_without_a_direction_sizes_nulls_and_repeats(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0] * 3), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, v), (7, v), (None, v), (8, [2.0, 4.0, 6.0]), (9, v[:2]), (10, [*v, 0.0]), (None, [9.0, 0.0, 0.0]), (11, [-1.0, -2.0, -3.0]), (12, [1e30, 2e30, 3e30]), (13, [1e-40, 2e-40, 3e-40]), (3, [0.0] * 3)]
    got = plain(near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    assert got == brute(rows)
    assert plain(near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>"))) == []
    assert plain(near_embeddings(spark.createDataFrame([(1, None), (None, None)], "vec_id long, embedding array<float>"))) == [(1, 0, 1), (None, 0, None)]


def test_counts_are_calibrated():
    rng = np.random.default_rng(1)
    p = Projections()
    deep, grids = p.grids(10**6)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.array([near(rng, v, p.cosine) for v in a])
    ways = rng.standard_normal((64, p.lines))
    hits = (np.abs(a @ ways - b @ ways) <= p.half).sum(axis=1)
    assert (hits >= p.count).mean() > 0.99
    cells = [np.floor((x @ (w := np.random.default_rng(2).standard_normal((64, deep * grids))) + np.random.default_rng(3).random(deep * grids) * p.width) / p.width).reshape(-1, grids, deep) for x in (a, b)]
    assert (cells[0] == cells[1]).all(axis=2).any(axis=1).mean() > 0.99
    assert replace(p, miss=0.1).count > p.count and Projections().grids(0)[0] == 1


def test_recall_over_random_clusters(spark):
    rnd, rng = random.Random(4), np.random.default_rng(6)
    centres = [rng.standard_normal(48) for _ in range(150)]
    vectors = [near(rng, rnd.choice(centres), rnd.uniform(0.93, 0.99)) for _ in range(1500)]
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    got = plain(near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    want = brute(rows)
    assert sum(n for _, n, _ in got) >= 0.999 * sum(n for _, n, _ in want)
