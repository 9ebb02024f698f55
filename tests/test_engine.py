"""The ordering engine: scenarios, invariants, files and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fillweave.operators import decompose as D
from fillweave.operators import factor as E
from fillweave.operators import incremental as I
from fillweave.operators import matrix as X
from fillweave.operators import mesh as M
from fillweave.operators import ordering as O
from fillweave.operators import tree as T
from fillweave.operators.incremental import Settings
from fillweave.plans import fixtures as G
from fillweave.sources import matrix_market, tables


@pytest.fixture(scope="module")
def grid(spark, sf_dir):
    nodes, edges = G.grid_nodes(spark, sf_dir).select("v"), G.grid_edges(spark, sf_dir)
    return nodes.cache(), edges.cache()


@pytest.fixture(scope="module")
def ordered(grid):
    return O.cold(*grid, Settings(levels=2))


def between(spark, ordering, a, b):
    """An edge between the smallest vertices of two regions."""
    first = lambda r: ordering.state.dof.where(F.col("hmd_id") == r).agg(F.min("v")).first()[0]
    return spark.createDataFrame([(first(a), first(b))], "u int, v int")


# regions of the new edge, and the subtree that has to be split again (None: nothing)
@pytest.mark.parametrize(("pair", "top"), [((0, 1), None), ((0, 5), None), ((1, 2), 0), ((3, 4), 1), ((5, 6), 2)])
def test_one_new_edge(spark, grid, ordered, pair, top):
    nodes, edges = grid
    got = O.warm(ordered.state, nodes, M.with_edges(edges, between(spark, ordered, *pair)), Settings(levels=2, lagging=False))
    n = nodes.count()
    if top is None:
        assert got.reuse == 1 and not got.rebuilt
        assert got.permutation.exceptAll(ordered.permutation).isEmpty()
    elif top == 0:
        assert got.rebuilt and got.reuse == 0
    else:
        sizes = {r["hmd_id"]: r["subtree_size"] for r in T.subtree_sizes(ordered.state.nodes.select("hmd_id", "size"), 2).collect()}
        assert got.reuse == pytest.approx(1 - sizes[top] / n)
        assert D.violations(got.state.dof.select("v", "hmd_id"), got.state.edges).isEmpty()
        assert X.is_permutation(got.permutation, "new_pos", n).first()["ok"]
        clean = got.reused_nodes.where("reused").select("hmd_id")
        before = ordered.state.dof.join(clean, "hmd_id", "left_semi")
        assert before.exceptAll(got.state.dof.select(before.columns)).isEmpty()


def test_lagging_leaves_deep_changes(spark, grid, ordered):
    nodes, edges = grid
    got = O.warm(ordered.state, nodes, M.with_edges(edges, between(spark, ordered, 3, 4)), Settings(levels=2, lag_level=0))
    assert got.reuse == 1


def test_relocation(spark, grid, ordered):
    nodes, edges = grid
    more = between(spark, ordered, 5, 6)
    got = O.warm(ordered.state, nodes, M.with_edges(edges, more), Settings(levels=2, lagging=False, aggressive=True))
    moved = got.state.dof.join(more.select("v"), "v").first()
    assert moved["hmd_id"] == 2
    assert X.is_permutation(got.permutation, "new_pos", nodes.count()).first()["ok"]


def test_many_added_vertices_are_ordered_anew(spark, grid, ordered):
    dof_map = spark.createDataFrame([(0, 0), (1, -1)], "new_v int, old_v int")
    assert I.too_many_added(dof_map, Settings())
    nodes, edges = spark.createDataFrame([(0,), (1,)], "v int"), spark.createDataFrame([(0, 1), (1, 0)], "u int, v int")
    assert O.warm(ordered.state, nodes, edges, Settings(levels=2), dof_map).rebuilt


def test_large_regions_are_split_by_joins(grid):
    nodes, edges = grid
    deep = D.decompose(nodes.select("v", F.lit(0).alias("hmd_id")), edges, 3, task_edges=10)
    assert D.violations(deep, edges).isEmpty()
    assert deep.count() == nodes.count()
    order = D.local_orders(deep, edges, task_edges=0)
    assert order.count() == nodes.count()


def test_children_come_before_their_separator(ordered):
    last = ordered.permutation.join(ordered.state.dof, "v").groupBy("hmd_id").agg(F.min("new_pos").alias("lo"), F.max("new_pos").alias("hi"))
    spans = {r["hmd_id"]: (r["lo"], r["hi"]) for r in last.collect()}
    for node, (_, hi) in spans.items():
        up = (node - 1) // 2
        if node and up in spans:
            assert hi < spans[up][0]


def test_wrong_method(grid):
    with pytest.raises(ValueError, match="no such ordering method"):
        O.cold(*grid, Settings(levels=1, method="morton"))
    assert Settings(levels=13).depth() == 10


def test_edgeless_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "v int")
    got = O.cold(nodes, spark.createDataFrame([], "u int, v int"), Settings(levels=2))
    assert [r["v"] for r in got.permutation.orderBy("new_pos").collect()] == list(range(5))


def test_kway(grid):
    nodes, edges = grid
    parts = D.kway(nodes.select("v", F.lit(0).alias("hmd_id")), edges, 2)
    assert parts.count() == nodes.count()
    assert {r["part"] for r in parts.select("part").distinct().collect()} == {0, 1, 2, 3}


def test_trees_by_parents(spark):
    parents = spark.createDataFrame([(0, 2, 1.0), (1, 2, 2.0), (2, 4, 3.0), (3, 4, 4.0), (4, -1, 5.0)], "v long, parent long, cost double")
    assert dict(E.depths(parents).collect()) == {0: 3.0, 1: 3.0, 2: 2.0, 3: 2.0, 4: 1.0}
    assert E.height(parents).first()[0] == 3.0
    assert dict(E.subtree_costs(parents, "cost").collect()) == {0: 1.0, 1: 2.0, 2: 6.0, 3: 4.0, 4: 15.0}
    assert dict(E.topological_levels(parents).collect()) == {0: 0, 1: 0, 2: 1, 3: 0, 4: 2}
    assert sorted(r["part"] for r in E.postorder_parts(parents, 2).collect()) == [0, 0, 0, 1, 1]


def test_poisson(spark):
    coo = X.poisson3d(3, spark)
    assert coo.count() == 27 + 2 * 3 * 18
    assert X.equal(coo, X.transpose(coo)).first().asDict() == {"unmatched": 0, "different": 0}


def test_matrix_market_round_trip(spark, tmp_path):
    coo = spark.createDataFrame([(0, 0, 1.5), (2, 1, -0.1), (1, 2, 3e-17), (2, 2, 3.0)], "row int, col int, val double")
    path = str(tmp_path / "m")
    matrix_market.write(coo, path, 3, 3)
    back = matrix_market.read_lines(spark, path).select("row", "col", "val")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, coo.collect()))


@pytest.mark.parametrize(
    ("text", "entries"),
    [
        ("%%MatrixMarket matrix coordinate real symmetric\n% note\n2 2 2\n1 1 4.0\n2 1 -1\n", [(0, 0, 4.0, 0.0), (1, 0, -1.0, 0.0)]),
        ("%%MatrixMarket matrix coordinate pattern general\n2 2 1\n2 2\n", [(1, 1, 1.0, 0.0)]),
        ("%%MatrixMarket matrix coordinate complex hermitian\n2 2 1\n2 1 1 2\n", [(1, 0, 1.0, 2.0)]),
        ("%%MatrixMarket matrix array integer symmetric\n2 2\n1\n2\n3\n", [(0, 0, 1.0, 0.0), (1, 0, 2.0, 0.0), (1, 1, 3.0, 0.0)]),
        ("%%MatrixMarket matrix coordinate integer general\n3 3 2\n1 2 3\n3 3 2\n", [(0, 1, 3.0, 0.0), (2, 2, 2.0, 0.0)]),
    ],
)
def test_matrix_market_source(spark, tmp_path, text, entries):
    path = tmp_path / "a.mtx"
    path.write_text(text)
    matrix_market.register(spark)
    assert sorted(map(tuple, spark.read.format("mtx").load(str(path)).collect())) == entries
    if " coordinate " in text:
        assert sorted(map(tuple, matrix_market.read_lines(spark, str(path)).collect())) == entries


@pytest.mark.parametrize("line", ["%MatrixMarket matrix coordinate real general", "%%MatrixMarket matrix array pattern general", "%%MatrixMarket matrix coordinate real hermitian"])
def test_bad_banner(line):
    with pytest.raises(ValueError):
        matrix_market.parse_banner(line)


def test_run_log(spark, tmp_path):
    record = {n: {"string": "x", "boolean": True, "double": 1.0}.get(t, 1) for n, t in tables.RUN_COLUMNS}
    tables.append_runs(spark, [record], str(tmp_path / "log"))
    tables.append_runs(spark, [record | {"solve_time": 3.0}], str(tmp_path / "log"))
    assert tables.median_seconds(tables.read_runs(spark, str(tmp_path / "log")), "reordering", "solve_time").first()["median"] == 2.0
    with pytest.raises(ValueError):
        tables.append_runs(spark, [{"reordering": "x"}], str(tmp_path / "log"))


def test_stream(spark, grid, ordered, tmp_path):
    from fillweave.streaming import maintain

    nodes, edges = grid
    folder, source = str(tmp_path / "states"), str(tmp_path / "changes")
    maintain.save(ordered, f"{folder}/start")
    more = between(spark, ordered, 3, 4).withColumn("op", F.lit("add"))
    more.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("u int, v int, op string").parquet(source)
    maintain.maintain(stream, folder, str(tmp_path / "at"), Settings(levels=2, lagging=False)).awaitTermination(300)
    state, permutation = maintain.load(spark, f"{folder}/0")
    assert state.edges.count() == edges.count() + 2
    assert X.is_permutation(permutation, "new_pos", nodes.count()).first()["ok"]
    assert D.violations(state.dof.select("v", "hmd_id"), state.edges).isEmpty()


@pytest.mark.parametrize(("n", "more", "block"), [(40, 30, 16), (30, 20, 8), (33, 0, 32), (1, 0, 8)])
def test_trees_and_fill_by_halving(spark, n, more, block):
    """The tree and fill of random graphs, in many blocks, are those of one elimination step by step."""
    rng = np.random.default_rng(n)
    ends = [(i, int(rng.integers(0, i))) for i in range(1, n) if rng.random() < 0.9] + [tuple(map(int, rng.choice(n, 2, replace=False))) for _ in range(more)]
    pairs = sorted({p for a, b in ends for p in ((a, b), (b, a))})
    order = rng.permutation(n)
    place = np.argsort(order)
    near = [set() for _ in range(n)]
    for a, b in pairs:
        near[place[a]].add(int(place[b]))
    parent, entries = [], []
    for k in range(n):
        later = {x for x in near[k] if x > k}
        entries.append(1 + len(later))
        parent.append(min(later, default=-1))
        for x in later:
            near[x] |= later - {x}
    perm = spark.createDataFrame([(i, int(v)) for i, v in enumerate(order)], "new_pos int, v int")
    edges = spark.createDataFrame(pairs, "u int, v int")
    got = sorted((r["v"], r["parent"], r["entries"]) for r in E.factor_columns(perm, edges, block).collect())
    assert got == list(zip(range(n), parent, entries))
    assert tuple(E.fill(perm, edges).first()) == (n, sum(entries), 2 * sum(entries) - n)
