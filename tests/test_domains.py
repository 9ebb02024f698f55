"""Minimum degree within domains of a region: few tables, the graph that elimination one by one leaves, and odd graphs."""

import random

import numpy as np
from pyspark.sql import functions as F

from fillweave.functions import kernels
from fillweave.operators import elimination
from fillweave.plans.lineage import Scratch
from tests.test_large import filled, grid, quotient


def test_domains_instead_of_rounds(spark, monkeypatch):
    """A shuffled grid of 900 vertices takes a few dozen tables, where a round for each independent set took hundreds, and no more fill."""
    made = []
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df: made.append(1) or table(self, df))
    n = 30
    vertices, edges, u, v = grid(spark, n, n)
    got = elimination.minimum_degree_labels(vertices.select(F.lit(0).alias("hmd_id"), "v"), edges.select(F.lit(0).alias("hmd_id"), "u", "v"), 1200).toPandas()
    assert sorted(got["label"]) == list(range(n * n)) and sorted(got["v"]) == list(range(n * n))
    assert filled(n * n, got.sort_values("label")["v"].to_numpy(), u, v) <= 1.3 * filled(n * n, kernels.minimum_degree(n * n, u, v), u, v)
    assert len(made) <= 30


def test_graph_after_domains(spark, monkeypatch):
    """Domains of 40 vertices, merged by joins first, then larger ones: each time what is left is the graph that elimination one by one leaves."""
    monkeypatch.setattr(elimination, "GROUPED", 250)
    vertices, edges, u, v = grid(spark, 12, 12)
    at = vertices.select(F.lit(0).alias("hmd_id"), F.col("v").cast("long").alias("v"), F.col("v").cast("long").alias("dom"))
    with Scratch(spark) as scratch:
        plain = scratch.table(edges.select(F.lit(0).alias("hmd_id"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
        members = scratch.table(plain.select("hmd_id", F.col("u").alias("e"), "v").limit(0))
        gone = []
        for most in (40, 144):
            one = F.lit(1).cast("long").alias("w")
            to = elimination.domains(at.select("hmd_id", "v", one), edges.select(F.lit(0).alias("hmd_id"), F.col("u").cast("long"), F.col("v").cast("long"), one).toDF("hmd_id", "u", "v", "w") if not gone else plain.select("hmd_id", "u", "v", one), most, scratch)
            if gone:
                # domains must hold whole elements: all that is left is one
                to = at.select("v", F.lit(0).cast("long").alias("to"))
            at = scratch.table(at.select("hmd_id", "v").join(to, "v").select("hmd_id", "v", F.col("to").alias("dom")))
            step, at, plain, members = elimination.by_domains(at, plain, members, 10**6, scratch)
            gone += [r["v"] for r in step.orderBy("dom", "place").collect()]
            left = quotient(144, u, v, gone)
            want = {(a, b) for a in range(144) for b in left[a]}
            got = {(r["u"], r["v"]) for r in plain.collect()}
            sets = {}
            for r in members.collect():
                sets.setdefault(r["e"], []).append(r["v"])
            assert got | {(a, b) for s in sets.values() for a in s for b in s if a != b} == want
            assert {r["v"] for r in at.collect()} == set(range(144)) - set(gone)
            assert len(gone) >= 50
    assert sorted(gone) == list(range(144))


def test_odd_regions(spark):
    """A hub with many leaves, single vertices and a dense part, in two regions, next to one that fits a task."""
    rng = random.Random(3)
    pairs = [(0, 0, i) for i in range(1, 200)]
    pairs += [(5, 1000 + a, 1000 + b) for a in range(30) for b in range(a)] + [(5, 1030 + i, 1031 + i) for i in range(100)]
    pairs += [(2, 3000, 3001)]
    pairs = {(h, a, b) for h, a, b in pairs} | {(h, b, a) for h, a, b in pairs}
    rows = [(0, i) for i in range(260)] + [(5, i) for i in range(1000, 1150)] + [(2, 3000), (2, 3001), (2, 3002)]
    rng.shuffle(rows)
    got = elimination.minimum_degree_labels(spark.createDataFrame(rows, "hmd_id int, v int"), spark.createDataFrame(sorted(pairs), "hmd_id int, u int, v int"), 150).toPandas()
    for h in (0, 2, 5):
        mine = got[got["hmd_id"] == h]
        assert sorted(mine["v"]) == sorted(v for k, v in rows if k == h) and sorted(mine["label"]) == list(range(len(mine)))
    assert len(got) == len(rows)


def test_elimination_of_free_vertices():
    """Only free vertices go, and cliques left behind are those of elimination one by one."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        n = 30
        pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (60, 2)) if a != b}
        pairs |= {(b, a) for a, b in pairs}
        u, v = (np.array(x) for x in zip(*sorted(pairs), strict=True))
        free = rng.random(n) < 0.6
        order, plain, members = kernels.eliminated_inside(n, u, v, [], free)
        assert sorted(order) == np.flatnonzero(free).tolist()
        left = quotient(n, u, v, order)
        got = {(a, b) for a in range(n) for b in plain[a]} | {(a, b) for s in members.values() for a in s for b in s if a != b}
        assert got == {(a, b) for a in range(n) for b in left[a]}
