"""Parts that grow from seeds: connected, of nearly one size, in a task and by joins."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fillweave.operators import growth


def grid_pairs(n, m):
    pairs = [(x * m + y, (x + a) * m + y + b) for x in range(n) for y in range(m) for a, b in ((1, 0), (0, 1)) if x + a < n and y + b < m]
    return pairs + [(b, a) for a, b in pairs]


def pieces(part, pairs):
    """Number of connected pieces of each part."""
    near = {v: [] for v in part}
    for u, v in pairs:
        if u in part and part[u] == part.get(v):
            near[u].append(v)
    seen, count = set(), Counter()
    for v in part:
        if v not in seen:
            count[part[v]] += 1
            todo = [v]
            seen.add(v)
            while todo:
                for y in near[todo.pop()]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
    return count


def parted(spark, n, pairs, parts, **more):
    edges = spark.createDataFrame(pairs, "u int, v int")
    got = growth.growth_partition(spark.range(n).select(F.col("id").cast("int").alias("v")), edges, parts, **more).collect()
    part = {r["v"]: r["part"] for r in got}
    assert len(got) == n and set(part) == set(range(n))
    return part


def test_in_task(spark):
    pairs = grid_pairs(40, 30)
    part = parted(spark, 1200, pairs, 7)
    assert set(pieces(part, pairs).values()) == {1}
    sizes = Counter(part.values())
    assert len(sizes) == 7 and max(sizes.values()) <= 1.1 * 1200 / 7 and min(sizes.values()) >= 0.9 * 1200 / 7


def test_by_joins(spark):
    pairs = grid_pairs(8, 8)
    part = parted(spark, 64, pairs, 3, tolerance=0.2, task_edges=0)
    assert set(pieces(part, pairs).values()) == {1}
    sizes = Counter(part.values())
    assert len(sizes) == 3 and max(sizes.values()) <= 26 and min(sizes.values()) >= 17


@pytest.mark.parametrize("task_edges", [1000, 0])
def test_odd_graphs(spark, task_edges):
    """Loops, repeated edges, a star, what no seed reaches, seeds named twice or not in the graph."""
    star = [(0, k) for k in range(1, 9)]
    pairs = star + [(b, a) for a, b in star] + star + [(3, 3), (10, 11), (11, 10)]
    seeds = spark.createDataFrame([(1, 0), (2, 1), (2, 5), (99, 2)], "v int, part int")
    part = parted(spark, 12, pairs, 3, seeds=seeds, task_edges=task_edges)
    assert [part[v] for v in (9, 10, 11)] == [-1] * 3
    assert set(part.values()) == {-1, 0, 1}
    reached = {v: p for v, p in part.items() if p >= 0}
    assert set(pieces(reached, pairs).values()) == {1}
    none = growth.growth_partition(spark.range(0).selectExpr("cast(id as int) v"), spark.createDataFrame([], "u int, v int"), 3, task_edges=task_edges)
    assert none.count() == 0


def test_random_graphs(spark):
    """Kernel alone: whatever the graph, parts are connected."""
    import pandas as pd

    for seed in range(30):
        rng = random.Random(seed)
        n = rng.randint(2, 60)
        pairs = {(a, b) for _ in range(2 * n) for a, b in [rng.sample(range(n), 2)]}
        pairs |= {(b, a) for a, b in pairs}
        k = rng.randint(1, min(n, 6))
        seeds = pd.DataFrame({"v": rng.sample(range(n), k), "part": range(k)})
        got = growth.grown_in_task(pd.DataFrame(sorted(pairs), columns=["u", "v"]), seeds, 0.1)
        part = dict(zip(got["v"].tolist(), got["part"].tolist(), strict=True))
        assert set(part.values()) == set(range(k))
        assert set(pieces(part, pairs).values()) == {1}


def test_wrong_number(spark):
    with pytest.raises(ValueError, match="parts"):
        growth.growth_partition(spark.range(3).selectExpr("id v"), spark.createDataFrame([], "u long, v long"), 0)


def test_parts_of_a_coarse_graph(spark, monkeypatch):
    """A graph too large for a task is parted by way of connected groups, without a round for each ring: each part is connected, near the mean, and has begun at its seed."""
    import numpy as np

    from fillweave.functions import kernels

    def rounds(*_):
        raise AssertionError("rounds of joins")

    monkeypatch.setattr(growth, "grown", rounds)
    n, m = 80, 10
    ids = np.arange(n * m).reshape(n, m)
    pairs = np.concatenate([np.stack([ids[1:].ravel(), ids[:-1].ravel()]), np.stack([ids[:, 1:].ravel(), ids[:, :-1].ravel()])], axis=1)
    u, v = np.concatenate([pairs, pairs[::-1]], axis=1)
    edges = spark.createDataFrame(list(zip(u.tolist(), v.tolist(), strict=True)), "u long, v long")
    vertices = spark.range(n * m + 3).withColumnRenamed("id", "v")
    seeds = spark.createDataFrame([(0, 0), (1, 1), (799, 2), (400, 3)], "v long, part int")
    got = growth.growth_partition(vertices, edges, 4, seeds, 0.2, task_edges=1000).toPandas().sort_values("v")["part"].to_numpy()
    assert (got[n * m :] == -1).all()
    got = got[: n * m]
    same = got[u] == got[v]
    assert len(np.unique(kernels.components(n * m, u[same], v[same]))) == 4 and set(got) == {0, 1, 2, 3}
    assert np.abs(np.bincount(got) - 200).max() <= 40
