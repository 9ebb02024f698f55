"""Compression of vertices with equal closed neighbourhoods, against comparison of all pairs."""

import random

from pyspark.sql import functions as F

from fillweave.operators import twins
from fillweave.operators.incremental import Settings


def graph(seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(20)}
    groups = [rng.randrange(14) for _ in range(40)]  # vertices by the coarse one that they copy
    out = {(a, b) for a in range(40) for b in range(40) if a != b and (groups[a] == groups[b] or (groups[a], groups[b]) in pairs or (groups[b], groups[a]) in pairs)}
    return out


def test_twins(spark):
    for seed in range(3):
        pairs = graph(seed)
        near = [frozenset({b for a, b in pairs if a == x} | {x}) for x in range(45)]
        want = {x: min(y for y in range(45) if near[y] == near[x]) for x in range(45)}
        vertices = spark.range(45).select(F.col("id").cast("int").alias("v"))
        edges = spark.createDataFrame(sorted(pairs), "u int, v int")
        assert {r["v"]: r["head"] for r in twins.twins(vertices, edges).collect()} == want


def test_expanded_order(spark):
    pairs = graph(7)
    vertices = spark.range(45).select(F.col("id").cast("int").alias("v"))
    order, groups = twins.compressed_order(vertices, spark.createDataFrame(sorted(pairs), "u int, v int"), Settings(levels=2))
    place = {r["v"]: r["new_pos"] for r in order.collect()}
    assert sorted(place.values()) == list(range(45))
    sets = {}
    for r in groups.collect():
        sets.setdefault(r["head"], []).append(place[r["v"]])
    assert all(max(s) - min(s) == len(s) - 1 for s in sets.values())
