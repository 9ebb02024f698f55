"""Regions larger than a task: separators by coarsening, orders by joins, against the kernels and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fillweave.functions import kernels
from fillweave.operators import coarsen, elimination
from fillweave.operators import decompose as D
from fillweave.plans.lineage import Scratch, shared_dir


def grid(spark, n, m, seed=1):
    """A grid whose ids are shuffled: vertices, edges, and both ends as arrays."""
    ids = list(range(n * m))
    random.Random(seed).shuffle(ids)
    pairs = [(ids[x * m + y], ids[(x + a) * m + y + b]) for x in range(n) for y in range(m) for a, b in ((1, 0), (0, 1)) if x + a < n and y + b < m]
    pairs += [(b, a) for a, b in pairs]
    u, v = (np.array(x) for x in zip(*pairs, strict=True))
    return spark.range(n * m).select(F.col("id").cast("int").alias("v")), spark.createDataFrame(pairs, "u int, v int"), u, v


def scratch_folders(spark):
    import os

    return [x for x in os.listdir(shared_dir(spark)) if x.startswith("scratch")]


def filled(n, order, u, v):
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    return int(kernels.factor_counts(n, place[u], place[v]).sum())


def test_bisect():
    """Few edges across, a third at least on each side; parts without edges between them too."""
    for n, m in ((12, 12), (5, 40)):
        ids = np.arange(n * m).reshape(n, m)
        pairs = np.concatenate([np.stack([ids[1:].ravel(), ids[:-1].ravel()]), np.stack([ids[:, 1:].ravel(), ids[:, :-1].ravel()])], axis=1)
        u, v = np.concatenate([pairs, pairs[::-1]], axis=1)
        side = kernels.bisect(n * m, u, v, np.ones(len(u)), np.ones(n * m))
        assert (side[u] != side[v]).sum() / 2 <= 1.5 * min(n, m)
        assert min((side == 0).sum(), (side == 1).sum()) * 3 >= n * m
    u, v = np.array([0, 1, 2, 3, 4, 5]), np.array([1, 0, 3, 2, 5, 4])
    side = kernels.bisect(6, u, v, np.ones(6), np.ones(6))
    assert 2 <= (side == 0).sum() <= 4


def test_separator_by_coarsening(spark):
    vertices, edges, u, v = grid(spark, 60, 60)
    got = D.separators(vertices.select("v", F.lit(0).alias("hmd_id")), edges.select(F.lit(0).alias("hmd_id"), "u", "v"), 1000).toPandas()
    side = np.empty(3600, dtype=int)
    side[got["v"]] = got["side"]
    assert len(got) == 3600 and (side == 2).sum() <= 120
    assert min((side == 0).sum(), (side == 1).sum()) >= 1200
    assert not (side[u] + side[v] == 1).any()
    assert not scratch_folders(spark)


def test_odd_graphs(spark):
    """A hub with many leaves, many small parts, vertices without edges, and two regions at once."""
    star = [(0, i) for i in range(1, 400)]
    paths = [(1000 + 3 * i + j, 1000 + 3 * i + j + 1) for i in range(200) for j in (0, 1)]
    rows = [(0, i) for i in range(420)] + [(5, i) for i in range(1000, 1620)]
    inside = [(0, *e) for e in star] + [(5, *e) for e in paths]
    inside += [(h, b, a) for h, a, b in inside]
    got = D.separators(spark.createDataFrame(rows, "hmd_id int, v int"), spark.createDataFrame(inside, "hmd_id int, u int, v int"), 50).toPandas()
    side = dict(zip(got["v"], got["side"], strict=True))
    assert len(side) == len(rows)
    assert all(side[a] + side[b] != 1 for _, a, b in inside)
    for h in (0, 5):
        n = [sum(side[v] == s for k, v in rows if k == h) for s in (0, 1, 2)]
        assert 3 * min(n[:2]) >= sum(n[:2]) and n[2] <= 20


def test_matching(spark):
    """Groups are disjoint, hold about two vertices, and pairs that propose to each other are edges."""
    _, edges, u, v = grid(spark, 14, 14)
    rows = edges.select(F.lit(0).alias("hmd_id"), F.col("u").cast("long"), F.col("v").cast("long"), F.lit(1).alias("w")).toDF("hmd_id", "u", "v", "w")
    pairs = {(r["a"], r["b"]) for r in coarsen.mutual(coarsen.proposals(rows, 3)).collect()}
    assert pairs <= set(zip(u.tolist(), v.tolist(), strict=True)) and len({x for p in pairs for x in p}) == 2 * len(pairs) > 60
    with Scratch(spark) as scratch:
        groups = coarsen.matching(rows, 3, scratch).collect()
    assert len({r["v"] for r in groups}) == len(groups)
    heads = {r["to"] for r in groups}
    assert len(heads) <= 0.65 * len(groups) and all(r["to"] <= r["v"] for r in groups)


def quotient(n, u, v, gone):
    """Plain edges and elements after eliminating vertices one by one, by the definition."""
    near = [set() for _ in range(n)]
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        near[a].add(b)
    for x in gone:
        for y in near[x]:
            near[y] |= near[x] - {y}
            near[y].discard(x)
        near[x] = set()
    return near


def test_quotient_graph(spark):
    """Two rounds of elimination leave the graph that elimination one by one leaves."""
    rng = random.Random(4)
    n = 40
    pairs = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(70)) if a != b}
    pairs |= {(b, a) for a, b in pairs}
    u, v = (np.array(x) for x in zip(*sorted(pairs), strict=True))
    plain = spark.createDataFrame([(0, a, b) for a, b in sorted(pairs)], "hmd_id int, u long, v long")
    members = spark.createDataFrame([], "hmd_id int, e long, v long")
    vertices = spark.range(n).select(F.lit(0).alias("hmd_id"), F.col("id").alias("v"))
    gone = []
    with Scratch(spark) as scratch:
        for turn in range(3):
            rated = scratch.table(elimination.degrees(vertices, plain, members))
            near = quotient(n, u, v, gone)
            for r in rated.collect():
                assert r["degree"] >= len(near[r["v"]])
            chosen = scratch.table(elimination.independent(rated, plain, members, turn))
            some = [r["v"] for r in chosen.collect()]
            assert some and not any(b in near[a] for a in some for b in some)
            plain, members = elimination.eliminated(chosen, plain, members, scratch)
            vertices = scratch.table(vertices.join(chosen, ["hmd_id", "v"], "left_anti"))
            gone += some
            want = {(a, b) for a, x in enumerate(quotient(n, u, v, gone)) for b in x}
            got = {(r["u"], r["v"]) for r in plain.collect()}
            sets = {}
            for r in members.collect():
                sets.setdefault(r["e"], []).append(r["v"])
            got |= {(a, b) for s in sets.values() for a in s for b in s if a != b}
            assert got == want


@pytest.mark.parametrize("method", ["nested", "mindegree"])
def test_orders_of_large_leaves(spark, method):
    """Fill within one and a half times that of the kernel on the whole graph."""
    n = 18
    vertices, edges, u, v = grid(spark, n, n)
    regions = vertices.select("v", F.lit(0).alias("hmd_id"))
    got = D.local_orders(regions, edges, method, 400, depth=0).toPandas()
    assert sorted(got["label"]) == list(range(n * n)) and set(got["hmd_id"]) == {0}
    kernel = kernels.nested_dissection if method == "nested" else kernels.minimum_degree
    assert filled(n * n, got.sort_values("label")["v"].to_numpy(), u, v) <= 1.5 * filled(n * n, kernel(n * n, u, v), u, v)
    assert not scratch_folders(spark)


def test_minimum_degree_with_groups():
    """A kernel that gets cliques orders as one that gets their edges."""
    rng = np.random.default_rng(6)
    for _ in range(5):
        groups = [rng.choice(30, 5, replace=False) for _ in range(6)]
        pairs = {(int(a), int(b)) for g in groups for a in g for b in g if a != b}
        u, v = (np.array(x) for x in zip(*sorted(pairs), strict=True))
        none = np.zeros(0, np.int64)
        assert kernels.minimum_degree(30, none, none, groups).tolist() == kernels.minimum_degree(30, u, v).tolist()


@pytest.mark.parametrize("task_edges", [0, 30, 1 << 20])
def test_components(spark, task_edges):
    """Paths in order, stars, cycles, loops and single vertices, by joins, in one task and both."""
    from fillweave.operators import factor

    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(80)] + [(200, 200 + i) for i in range(1, 40)] + [(300 + i, 300 + (i + 1) % 7) for i in range(7)] + [(400, 400)]
    pairs += [(500 + rng.randrange(40), 500 + rng.randrange(40)) for _ in range(30)]
    pairs += [(b, a) for a, b in pairs]
    vertices = spark.range(600).withColumnRenamed("id", "v")
    got = {r["v"]: r["comp"] for r in factor.components(vertices, spark.createDataFrame(pairs, "u long, v long"), task_edges).collect()}
    want = list(range(600))
    for _ in range(90):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got == dict(enumerate(want))
    assert not scratch_folders(spark)


def test_factor_of_large_random_graphs(spark):
    """Parents and counts by blocks against elimination step by step on 500 vertices, and columns of A'A without A'A."""
    from fillweave.operators import factor
    from tests.test_kernels import brute_fill, random_graph

    n = 500
    u, v = random_graph(n, 900, 3)
    counts, parent = brute_fill(n, u, v)
    order = spark.range(n).select(F.col("id").cast("int").alias("new_pos"), F.col("id").cast("int").alias("v"))
    edges = spark.createDataFrame(list(zip(u.tolist(), v.tolist(), strict=True)), "u int, v int")
    got = sorted(tuple(r) for r in factor.factor_columns(order, edges, 128).select("v", "parent", "entries").collect())
    assert got == [(k, parent[k], counts[k]) for k in range(n)]
    rng = random.Random(5)
    rows = [(r, c) for r in range(60) for c in {rng.randrange(50) for _ in range(3)}]
    place = list(range(50))
    rng.shuffle(place)
    pairs = {(place[a], place[b]) for r, a in rows for q, b in rows if r == q and a != b}
    counts, parent = brute_fill(50, *(np.array(x) for x in zip(*sorted(pairs), strict=True)))
    order = spark.createDataFrame([(p, c) for c, p in enumerate(place)], "new_pos int, v int")
    got = sorted(tuple(r) for r in factor.column_elimination_tree(spark.createDataFrame(rows, "row int, col int"), order, 16).select("v", "parent", "entries").collect())
    assert got == [(k, parent[k], counts[k]) for k in range(50)]


def test_column_stars_have_each_edge_once(spark):
    """By positions, from the first column of a row to its others: no reverse, and no join to number them again."""
    from fillweave.operators import factor

    rows, place = [(0, 3), (0, 1), (0, 2), (1, 2), (1, 3), (2, 0), (3, 1), (3, 3)], [2, 3, 1, 0]
    order = spark.createDataFrame([(p, c) for c, p in enumerate(place)], "new_pos int, v int")
    with Scratch(spark) as scratch:
        got = sorted(tuple(r) for r in factor.column_stars(spark.createDataFrame(rows, "row int, col int"), order, scratch).collect())
    assert got == [(0, 1), (0, 3)]


def test_small_regions_go_down_all_levels_at_once(spark):
    """The regions are those of separators taken level by level, and five levels cost no more jobs than a few joins."""
    n, depth = 18, 5
    vertices, edges, u, v = grid(spark, n, n)
    sc = spark.sparkContext
    sc.setJobGroup("levels", "levels")
    got = D.decompose(vertices.select("v", F.lit(0).alias("hmd_id")), edges, depth).toPandas().sort_values("v")["hmd_id"].to_numpy()
    jobs = len(sc.statusTracker().getJobIdsForGroup("levels"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    want = np.zeros(n * n, dtype=np.int64)
    for node in range(2**depth - 1):
        own = np.flatnonzero(want == node)
        inside = (want[u] == node) & (want[v] == node)
        if inside.any():
            side = kernels.level_separator(len(own), np.searchsorted(own, u[inside]), np.searchsorted(own, v[inside]))
            want[own] = np.where(side == 2, node, 2 * node + 1 + side)
    assert (got == want).all() and len(set(want)) > 40
    assert jobs <= 40


def test_several_levels_from_one_coarsening(spark, monkeypatch):
    """A grid that takes two levels to fit tasks is coarsened once; no edge leads across, separators are small and parts even."""
    called = []
    whole = D.coarse_parts
    monkeypatch.setattr(D, "coarse_parts", lambda *a: called.append(a[2]) or whole(*a))
    monkeypatch.setattr(D, "coarse_separators", lambda *a: called.append(1) or coarsen.coarse_separators(*a))
    vertices, edges, u, v = grid(spark, 40, 40)
    got = D.decompose(vertices.select("v", F.lit(0).alias("hmd_id")), edges, 3, 2500)
    assert D.violations(got, edges).isEmpty()
    at = got.toPandas().sort_values("v")["hmd_id"].to_numpy()
    assert len(at) == 1600 and called == [2]
    assert (at < 3).sum() <= 3 * 80 and set(at) == set(range(15))
    parts = [sum((at == k) | ((at - 1) // 2 == k) for k in [top]).sum() for top in range(3, 7)]
    assert min(parts) >= 200
    assert not scratch_folders(spark)


@pytest.mark.parametrize("bound", [0, 1 << 22])
def test_halves_in_tasks(spark, monkeypatch, bound):
    """Halves that fit tasks take no search for components by joins; those that don't give the same factor by joins."""
    from fillweave.operators import factor
    from tests.test_kernels import brute_fill, random_graph

    searched = []
    whole = factor.components
    monkeypatch.setattr(factor, "components", lambda *a, **k: searched.append(1) or whole(*a, **k))
    monkeypatch.setattr(factor, "TASK_EDGES", bound)
    n = 200
    u, v = random_graph(n, 330, 5)
    counts, parent = brute_fill(n, u, v)
    order = spark.range(n).select(F.col("id").cast("int").alias("new_pos"), F.col("id").cast("int").alias("v"))
    edges = spark.createDataFrame(list(zip(u.tolist(), v.tolist(), strict=True)), "u int, v int")
    got = sorted(tuple(r) for r in factor.factor_columns(order, edges, 64).select("v", "parent", "entries").collect())
    assert got == [(k, parent[k], counts[k]) for k in range(n)]
    assert bool(searched) == (bound == 0)


def test_stars_from_repeated_entries(spark):
    """Entries of a matrix that come more than once give each edge once."""
    from fillweave.operators import factor

    order = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "new_pos int, v int")
    with Scratch(spark) as scratch:
        got = sorted(tuple(r) for r in factor.column_stars(spark.createDataFrame([(0, 1), (0, 2), (0, 1), (1, 0), (1, 0), (1, 1)], "row int, col int"), order, scratch).collect())
    assert got == [(0, 2), (1, 2)]
