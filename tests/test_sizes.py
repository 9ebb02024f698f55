"""Plans that don't depend on the size of compressed files, and products that throw nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fillweave.functions import kernels
from fillweave.operators import coarsen, factor
from fillweave.operators import decompose as D
from fillweave.operators import matrix as X
from fillweave.operators import mesh as M
from fillweave.plans import fixtures as G
from fillweave.plans.lineage import Scratch, cut


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ids_are_not_broadcast(spark, sf_dir):
    """Tables whose files look small are joined by shuffles, as are those that an operator has written or cut."""
    nodes, edges = G.grid_nodes(spark, sf_dir).select("v"), G.grid_edges(spark, sf_dir)
    assert "BroadcastHashJoin" not in plan(edges)
    assert "BroadcastHashJoin" not in plan(M.check_mesh(edges))
    _, after, dof_map = M.without_vertices(nodes, edges, G.removed_nodes(spark, sf_dir))
    assert "BroadcastHashJoin" not in plan(after) and "BroadcastHashJoin" not in plan(dof_map)
    ids = spark.range(100).withColumnRenamed("id", "v")
    with Scratch(spark) as scratch:
        assert "SortMergeJoin" in plan(scratch.table(ids).join(ids, "v"))
    assert "SortMergeJoin" in plan(cut(ids).join(ids, "v"))
    assert "BroadcastHashJoin" in plan(cut(ids).join(F.broadcast(ids), "v"))


def test_checked_product(spark):
    """All pairs of longs at the bounds, without an expression that catches its own exceptions."""
    low, high = -(2**63), 2**63 - 1
    values = [low, low + 1, low // 2 - 1, low // 2, -3037000500, -7, -2, -1, 0, 1, 2, 7, 3037000499, 3037000500, high // 7, high // 7 + 1, high // 2, high // 2 + 1, high, None]
    pairs = spark.createDataFrame([(a, b) for a in values for b in values], "a long, b long")
    product = X.checked_product(F.col("a"), F.col("b"))
    assert "try_" not in str(product)
    got = pairs.select("a", "b", product.alias("x"))
    for a, b, x in got.collect():
        assert x == (None if a is None or b is None or not low <= a * b <= high else a * b)


@pytest.mark.parametrize("method", ["nested", "mindegree"])
def test_large_leaf_without_rounds(spark, monkeypatch, method):
    """A leaf of three times the edges that a task orders is parted in tasks: no coarsening and no elimination by joins."""

    def rounds(*_):
        raise AssertionError("rounds of joins")

    for name in ("coarse_separators", "minimum_degree_labels"):
        monkeypatch.setattr(D, name, rounds)
    at = [(x, y) for x in range(18) for y in range(18)]
    pairs = [(18 * x + y, 18 * (x + a) + y + b) for x, y in at for a, b in ((1, 0), (0, 1)) if x + a < 18 and y + b < 18]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "u int, v int")
    regions = spark.range(324).select(F.col("id").cast("int").alias("v"), F.lit(0).alias("hmd_id"))
    got = D.local_orders(regions, edges, method, 400, depth=0).collect()
    assert sorted(r["label"] for r in got) == list(range(324)) and sorted(r["v"] for r in got) == list(range(324))


def test_sums_in_parts(spark, monkeypatch):
    """As many partitions as entries call for, whatever the session's number, and the same sums."""
    monkeypatch.setattr(X, "TASK_ROWS", 10)
    assert X.task_parts(80) is None and X.task_parts(301) == 31
    rows = spark.range(300).select((F.col("id") % 20).cast("int").alias("row"), (F.col("id") % 7).cast("int").alias("col"), F.lit(1.0).alias("val"))
    for got, want in ((X.summed(rows, 31), X.summed(rows)), (X.symmetric(rows, parts=31), X.symmetric(rows)), (X.add(rows, X.transpose(rows), 2.0, -1.0, 31), X.add(rows, X.transpose(rows), 2.0, -1.0))):
        assert "hashpartitioning(row#" in plan(got) and ", 31)" in plan(got)
        assert sorted(got.collect()) == sorted(want.collect())


def _path_of_rows(spark, n, m):
    """A grid whose ids go row by row: regions(hmd_id, v), inside(hmd_id, u, v)."""
    at = [(x, y) for x in range(n) for y in range(m)]
    pairs = [(m * x + y, m * (x + a) + y + b) for x, y in at for a, b in ((1, 0), (0, 1)) if x + a < n and y + b < m]
    rows = [(0, a, b) for a, b in pairs] + [(0, b, a) for a, b in pairs]
    return spark.range(n * m).select(F.lit(0).alias("hmd_id"), F.col("id").alias("v")), spark.createDataFrame(rows, "hmd_id int, u long, v long")


def test_groups_are_not_broadcast(spark):
    """What a matching has found, a table that grows with the graph, is joined by shuffles, also where regions were chosen before."""
    regions, inside = _path_of_rows(spark, 20, 10)
    some = F.broadcast(regions.select("hmd_id").distinct())
    with Scratch(spark) as scratch:
        edges = scratch.table(inside.withColumn("w", F.lit(1))).join(some, "hmd_id", "left_semi")
        seen = []
        write = scratch.table
        scratch.table = lambda df: seen.append(plan(df)) or write(df)
        last = coarsen.matching(edges, 0, scratch)
    assert len(seen) == 4
    # the one broadcast is that of the regions; plans end with the tables that are named before
    assert max(p.count("BroadcastHashJoin") for p in seen) <= 1
    assert "BroadcastHashJoin" not in plan(last)


def test_ranges_of_ids_merge_in_tasks(spark, monkeypatch):
    """A graph whose edges lead to near ids is coarsened by ranges, without a matching by joins, and parted well."""

    def rounds(*_):
        raise AssertionError("rounds of joins")

    monkeypatch.setattr(coarsen, "matching", rounds)
    monkeypatch.setattr(coarsen, "RANGE", 256)
    regions, inside = _path_of_rows(spark, 80, 12)
    got = coarsen.coarse_separators(regions, inside, 300).toPandas()
    side = got.set_index("v")["side"]
    pairs = inside.toPandas()
    assert len(side) == 960 and not (side[pairs["u"]].to_numpy() + side[pairs["v"]].to_numpy() == 1).any()
    assert (side == 2).sum() <= 24 and min((side == 0).sum(), (side == 1).sum()) >= 320


def test_dense_ranges_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(coarsen, "RANGE_EDGES", 10)
    _, inside = _path_of_rows(spark, 4, 2)
    edges = inside.withColumn("w", F.lit(1))
    assert {r["at"] for r in coarsen.range_edges(edges.where("u < 4 and v < 4 or u >= 4 and v >= 4"), 4).collect()} == {0, 1}
    assert coarsen.range_edges(edges, 8).isEmpty()


def test_merged_groups():
    """Groups are connected, weigh no more than they may, and most vertices have one."""
    n, m = 40, 10
    ids = np.arange(n * m).reshape(n, m)
    pairs = np.concatenate([np.stack([ids[1:].ravel(), ids[:-1].ravel()]), np.stack([ids[:, 1:].ravel(), ids[:, :-1].ravel()])], axis=1)
    u, v = np.concatenate([pairs, pairs[::-1]], axis=1)
    name = kernels.merged(n * m, u, v, np.ones(len(u)), np.ones(n * m), 16.0)
    assert (name <= np.arange(n * m)).all() and (name[name] == name).all()
    assert np.bincount(name).max() <= 16 and len(np.unique(name)) <= n * m / 8
    same = name[u] == name[v]
    assert (kernels.components(n * m, u[same], v[same]) == name).all()


def test_components_by_ranges(spark, monkeypatch):
    """With ranges contracted first few edges are left to name, and names are the same; ranges of too many edges go with the rest."""
    _, inside = _path_of_rows(spark, 40, 5)
    edges = inside.where("u <> 60 and v <> 60 and not (u div 5 = 20 or v div 5 = 20)").select("u", "v")
    vertices = spark.range(200).withColumnRenamed("id", "v")
    want = sorted(factor.components(vertices, edges).collect())
    monkeypatch.setattr(factor, "RANGED", 0)
    named = factor._range_names(edges, 50).collect()
    assert len({r["name"] for r in named}) == 4 and len(named) > 180
    assert sorted(factor.components(vertices, edges, 1 << 20, 50).collect()) == want
    monkeypatch.setattr(factor, "TASK_EDGES", 10)
    assert factor._range_names(edges, 50).isEmpty()
    assert sorted(factor.components(vertices, edges, 1 << 20, 50).collect()) == want


def broadcast_nodes(spark, run):
    """How many broadcasts the final plans have of all that `run` executes."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def executions():
        bus.waitUntilEmpty()
        found = store.executionsList()
        return [found.apply(k) for k in range(found.size())]

    last = max((x.executionId() for x in executions()), default=-1)
    run()
    plans = [x.physicalPlanDescription().split("+- == Initial Plan ==")[0] for x in executions() if x.executionId() > last]
    assert plans
    return sum(p.count("BroadcastExchange") for p in plans)


def square(spark, n):
    """(vertices(v), edges(u, v)) of a grid of n x n cells, ids row by row."""
    pairs = [(k, k + s) for k in range(n * n) for s in (1, n) if k + s < n * n and (s == n or k % n < n - 1)]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "u int, v int")
    return spark.range(n * n).select(F.col("id").cast("int").alias("v")), edges


def test_factor_without_broadcasts(spark):
    """Components and their heads are joined by shuffles in each halving, however few rows they have."""
    vertices, edges = square(spark, 12)
    order = cut(vertices.select(F.col("v").alias("new_pos"), "v"))
    got = []
    assert broadcast_nodes(spark, lambda: got.extend(factor.factor_columns(order, cut(edges), 16).collect())) == 0
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in factor.factor_columns(order, edges, 1 << 16).collect())


def test_open_regions_without_broadcasts(spark):
    """Levels choose the regions that tasks split or order by their numbers, not by joins with tables of them."""
    vertices, edges = (cut(x) for x in square(spark, 18))
    found = []

    def run():
        regions = D.decompose(vertices.select("v", F.lit(0).alias("hmd_id")), edges, 3, 5000)
        found.append(regions)
        found.append(D.local_orders(regions, edges, depth=3).collect())

    assert broadcast_nodes(spark, run) == 0
    assert D.violations(found[0], edges).isEmpty() and len(found[1]) == 324
