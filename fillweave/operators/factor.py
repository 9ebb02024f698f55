"""Elimination trees, fill of the Cholesky factor, and trees given by parents.

The order is halved again and again: what the connected parts of a lower half do to the upper
half is written down as edges there, so that halves become independent and blocks of bounded
width are left, one for each task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.lineage import Scratch, cut, large

#: Positions of an order that one task eliminates.
BLOCK = 1 << 16
#: Directed edges whose components one task names.
TASK_EDGES = 4_000_000
#: Directed edges above which ranges of ids are contracted before all others; one task is as soon done with less.
RANGED = 1_000_000


def _range_names(edges: DataFrame, width: int) -> DataFrame:
    """u, name: the smallest vertex of the part that each end of an edge is in, by the edges within its range of ids, a task for each range.

    Vertices in no such edge have no row; nor have those of ranges of more than TASK_EDGES edges.
    """

    def run(near: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(near[["u", "v"]].to_numpy(), return_inverse=True)
        u, v = at.reshape(-1, 2).T
        return pd.DataFrame({"u": ids, "name": ids[kernels.components(len(ids), u, v)]})

    kind = edges.schema["u"].dataType.simpleString()
    inside = edges.withColumn("at", F.expr(f"u div {width}")).where(f"at = v div {width} and u < v")
    few = inside.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") <= TASK_EDGES).drop("n")
    return large(inside).join(few, "at", "left_semi").groupBy("at").applyInPandas(run, f"u {kind}, name {kind}")


def components(vertices: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES, width: int | None = None) -> DataFrame:
    """v, comp: the smallest vertex of its connected component.

    In each round vertices stand in a random order and every one takes the name of its first
    neighbour, if that comes before itself; such chains are short, and names are followed four
    steps. The edges are contracted to the names: what is settled is gone, and about a third of the
    vertices are left, of a path as of any other graph. At most task_edges edges are left to one
    task. Names are put together on the way back. With a `width` edges within ranges of so many ids are
    contracted first, a task for each range, which helps where most edges lead to near ids.
    """

    def rest(near: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(near.to_numpy(), return_inverse=True)
        u, v = at.reshape(-1, 2).T
        return pd.DataFrame({"u": ids, "name": ids[kernels.components(len(ids), u, v)]})

    with Scratch(vertices.sparkSession) as scratch:
        left, rounds = scratch.table(edges.select("u", "v").where("u <> v").distinct()), []
        kind = left.schema["u"].dataType.simpleString()
        if width and left.count() > min(task_edges, RANGED):
            near = _range_names(left, width)
            ends = left.select("u").distinct()
            hook = scratch.table(ends.join(near, "u", "left").select("u", F.coalesce("name", "u").alias("name")))
            rounds.append(hook)
            a, b = hook.select("u", F.col("name").alias("a")), hook.select(F.col("u").alias("v"), F.col("name").alias("b"))
            left = scratch.table(left.join(a, "u").join(b, "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        while left.count() > task_edges:
            place = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("h"), F.col(c).alias("x"))
            first = left.groupBy("u").agg(F.min(place("v")).alias("first"))
            hook = scratch.table(first.select("u", F.least("first", place("u"))["x"].alias("name")))
            for _ in range(2):
                hook = hook.join(hook.select(F.col("u").alias("name"), F.col("name").alias("up")), "name").select("u", F.col("up").alias("name"))
            hook = scratch.table(hook)
            rounds.append(hook)
            a, b = hook.select("u", F.col("name").alias("a")), hook.select(F.col("u").alias("v"), F.col("name").alias("b"))
            left = scratch.table(left.join(a, "u").join(b, "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        above = left.groupBy().applyInPandas(rest, f"u {kind}, name {kind}")
        for hook in reversed(rounds):
            higher = hook.join(above.select(F.col("u").alias("name"), F.col("name").alias("top")), "name", "left")
            above = higher.select("u", F.coalesce("top", "name").alias("name"))
        above = large(above)
        least = above.groupBy("name").agg(F.min("u").alias("comp"))
        named = above.join(least, "name").select(F.col("u").alias("v"), "comp")
        return cut(vertices.join(named, "v", "left").select("v", F.coalesce("comp", "v").alias("comp")))


def _numbered(permutation: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by the positions of their ends in an order."""
    a = permutation.select(F.col("v").alias("u"), F.col("new_pos").alias("nu"))
    b = permutation.select("v", F.col("new_pos").alias("nv"))
    return edges.join(large(a), "u").join(large(b), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))


def _block_components(positions: DataFrame, inside: DataFrame, block: int) -> DataFrame:
    """v, comp: the last position of its connected part within its block, a task for each block."""

    def run(key, rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(rows["v"].to_numpy())
        u, v = np.searchsorted(own, near["u"].to_numpy()), np.searchsorted(own, near["v"].to_numpy())
        up = kernels.elimination_tree(len(own), np.concatenate([u, v]), np.concatenate([v, u])).tolist()
        root = list(range(len(own)))
        for k in reversed(root[:]):
            root[k] = root[up[k]] if up[k] >= 0 else k
        return pd.DataFrame({"v": own, "comp": own[root]})

    left = positions.select(F.expr(f"v div {block}").alias("of"), "v").groupBy("of")
    right = inside.select(F.expr(f"u div {block}").alias("at"), F.col("u").alias("u"), F.col("v").alias("v")).groupBy("at")
    return left.cogroup(right).applyInPandas(run, "v int, comp int")


def _half_stars(lower: DataFrame, width: int) -> DataFrame:
    """Edges (u, v) from the first neighbour above of each connected part of a half to its others there, a task for each half.

    lower(u, v) are the edges whose lower end u is in a half, of any higher end v.
    """

    def run(key, near: pd.DataFrame) -> pd.DataFrame:
        u, v = near["u"].to_numpy(dtype=np.int64), near["v"].to_numpy(dtype=np.int64)
        inside = v // width == key[0]
        ids, at = np.unique(np.concatenate([u, v[inside]]), return_inverse=True)
        part = kernels.components(len(ids), at[: len(u)][inside], at[len(u) :])[at[: len(u)][~inside]]
        order = np.lexsort((v[~inside], part))
        part, far = part[order], v[~inside][order]
        # the first row of each part has its head; one beyond the upper half has been told of in an earlier round
        begins = np.flatnonzero(np.diff(part, prepend=-1))
        head = np.repeat(far[begins], np.diff(np.append(begins, len(part))))
        some = (head != far) & (head // width == key[0] + 1)
        return pd.DataFrame({"u": head[some], "v": far[some]}).drop_duplicates()

    kind = lower.schema["v"].dataType.simpleString()
    return lower.withColumn("half", F.expr(f"u div {width}")).groupBy("half").applyInPandas(run, f"u {kind}, v {kind}").select("u", "v")


def _joined_stars(positions: DataFrame, lower: DataFrame, width: int, block: int) -> DataFrame:
    """_half_stars() for halves of too many edges for a task, by joins."""
    inside = lower.where(f"u div {width} = v div {width}")
    below = positions.where(f"(v div {width}) % 2 = 0")
    named = components(below, inside.union(inside.select("v", "u")).toDF("u", "v"), width=block) if width > block else _block_components(below, inside, block)
    across = lower.where(f"u div {width} <> v div {width}")
    reached = large(across.join(named.withColumnRenamed("v", "u"), "u").select("comp", "v").distinct())
    # a part whose first neighbour is beyond the upper half has been told of in an earlier round
    head = reached.groupBy("comp").agg(F.min("v").alias("head")).where(f"head div {width} = comp div {width} + 1")
    return reached.join(head, "comp").where("v <> head").select(F.col("head").alias("u"), "v").distinct()


def _block_columns(positions: DataFrame, pairs: DataFrame, block: int) -> DataFrame:
    """v, parent, entries of all columns, a task for each block; pairs(u, v) belong to the block of u, the lower end."""

    def run(key, rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(rows["v"].to_numpy())
        ids = np.union1d(own, near["v"].to_numpy())  # rows above the block come after its own
        u, v = np.searchsorted(ids, near["u"].to_numpy()), np.searchsorted(ids, near["v"].to_numpy())
        up, entries = kernels.factor_columns(len(ids), np.concatenate([u, v]), np.concatenate([v, u]), len(own))
        return pd.DataFrame({"v": own, "parent": np.where(up >= 0, ids[up], -1), "entries": entries})

    left = positions.select(F.expr(f"v div {block}").alias("of"), "v").groupBy("of")
    right = pairs.select(F.expr(f"u div {block}").alias("at"), F.col("u").alias("u"), F.col("v").alias("v")).groupBy("at")
    return left.cogroup(right).applyInPandas(run, "v int, parent long, entries long")


def factor_columns(permutation: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """v, parent, entries of each column of the permuted matrix's Cholesky factor, by positions from 0.

    parent is that in the elimination tree (-1 at roots), entries counts the diagonal too. Once a
    connected part of a lower half is eliminated, its neighbours above are a clique. Edges from
    the first of them to the others give the same factor, as the first one's elimination makes
    the clique. With these edges the columns of the upper half no longer need the lower half.
    There are as many rounds as halvings down to blocks, each with one search for components, in
    a task for each half where none has more than TASK_EDGES edges.
    """
    return _factored(permutation, _numbered(permutation, edges).where("u < v"), block)


def _factored(permutation: DataFrame, pairs: DataFrame, block: int) -> DataFrame:
    """factor_columns() of edges(u, v) given by positions, u < v."""
    with Scratch(permutation.sparkSession) as scratch:
        positions = scratch.table(permutation.select(F.col("new_pos").cast("int").alias("v")))
        top = positions.agg(F.max("v")).first()[0]
        pairs = scratch.table(pairs.distinct())
        width = block
        while width <= (top or 0):
            width *= 2
        while width > block:
            width //= 2
            lower = pairs.where(f"(u div {width}) % 2 = 0")
            most = lower.groupBy(F.expr(f"u div {width}")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
            star = _half_stars(lower, width) if (most or 0) <= TASK_EDGES else _joined_stars(positions, lower, width, block)
            pairs = pairs.union(scratch.table(star))  # what comes twice does no harm
        return cut(_block_columns(positions, pairs, block))


def column_stars(entries: DataFrame, permutation: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u, v), u < v, by positions of a graph of columns whose factor is that of A'A; entries(row, col) are A's.

    A row makes a clique of its columns in A'A. Here it gives a star only, on the one of its columns
    that comes first in the order: its elimination makes the clique. So A'A is never formed, and
    there are less edges than entries.
    """
    order = large(permutation.select(F.col("v").alias("col"), F.col("new_pos").cast("int").alias("v")))
    at = large(entries.select("row", "col")).join(order, "col").select("row", "v")
    # both sides of a join by rows would be shuffled, a window shuffles once and holds no row of A whole
    first = at.select("v", F.min("v").over(Window.partitionBy("row")).alias("u"))
    return first.where("u < v").select("u", "v").distinct()


def column_elimination_tree(entries: DataFrame, permutation: DataFrame, block: int = BLOCK) -> DataFrame:
    """v, parent, entries of the factor of A'A by positions of the columns, as factor_columns() gives them."""
    with Scratch(permutation.sparkSession) as scratch:
        return _factored(permutation, column_stars(entries, permutation, scratch), block)


def fundamental_supernodes(columns: DataFrame) -> DataFrame:
    """v and the first column of its supernode, from columns(v, parent, entries) of a factor.

    A column goes on the supernode of the one before it if that is its only child and has just
    one entry more. Runs are named within ranges of 65536 columns, and a range that begins
    within a run takes its name from the ranges before.
    """
    prior = columns.select((F.col("v") + 1).alias("v"), F.col("parent").alias("up"), F.col("entries").alias("before"))
    children = columns.where("parent >= 0").groupBy(F.col("parent").alias("v")).agg(F.count("*").alias("children"))
    joined = columns.join(prior, "v", "left").join(children, "v", "left")
    goes_on = (F.col("up") == F.col("v")) & (F.col("before") == F.col("entries") + 1) & (F.col("children") == 1)
    rows = joined.select("v", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("v")).alias("start"), F.expr("v div 65536").alias("range"))
    run = F.max("start").over(Window.partitionBy("range").orderBy("v"))
    ends = rows.groupBy("range").agg(F.max("start").alias("end"))
    carried = ends.select("range", F.max("end").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return rows.withColumn("run", run).join(carried, "range").select("v", F.coalesce("run", "carried").alias("supernode"))


def supernode_dependencies(supernodes: DataFrame, entries: DataFrame) -> DataFrame:
    """supernode, depends: each supernode itself and those that hold the rows of its columns' entries below the diagonal, once each.

    entries(u, v) are positions of a matrix's entries, u the column.
    """
    a = supernodes.select(F.col("v").alias("u"), "supernode")
    b = supernodes.select("v", F.col("supernode").alias("depends"))
    across = entries.where("v > u").join(a, "u").join(b, "v").select("supernode", "depends")
    return across.union(supernodes.select("supernode", F.col("supernode").alias("depends"))).distinct()


def elimination_tree(permutation: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """v, parent of the elimination tree of the permuted matrix, both as positions from 0; -1 at roots."""
    return factor_columns(permutation, edges, block).select("v", "parent")


def fill(permutation: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row: vertices, entries of the factor, and of the factor and its transpose together."""
    counts = factor_columns(permutation, edges, block)
    return counts.agg(F.count("*").alias("n"), F.sum("entries").alias("lnz")).select("n", "lnz", (2 * F.col("lnz") - F.col("n")).alias("l_nnz"))


def children(parents: DataFrame) -> DataFrame:
    """parent and its children in ascending order; parents(v, parent)."""
    return parents.where("parent >= 0").groupBy("parent").agg(F.sort_array(F.collect_list("v")).alias("children"))


def _doubled(parents: DataFrame, weight: str) -> DataFrame:
    """v, depth: the weights on the path from v to its root, by pointer doubling."""
    state = cut(parents.select("v", F.col("parent").alias("up"), F.col(weight).cast("double").alias("depth")))
    while not state.where("up >= 0").isEmpty():
        above = state.select(F.col("v").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        step = state.join(above, "up", "left")
        state = cut(step.select("v", F.coalesce("next", F.lit(-1)).cast("long").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0.0))).alias("depth")))
    return state.select("v", "depth")


def depths(parents: DataFrame, weight: str | None = None) -> DataFrame:
    """v and its depth: nodes (or their weights) on the path to the root, itself included."""
    rows = parents if weight else parents.withColumn("one", F.lit(1))
    return _doubled(rows, weight or "one")


def height(parents: DataFrame, weight: str | None = None) -> DataFrame:
    return depths(parents, weight).agg(F.max("depth").alias("height"))


def _gathered(parents: DataFrame, start, combine, far) -> DataFrame:
    """v and what its subtree gathers, by pointer doubling: a path of n vertices takes log2(n) rounds.

    After k rounds each vertex has what those less than 2**k below it give, and `up` is its
    ancestor at that distance. start is a vertex's own value, combine the aggregate over others,
    far(value, distance) a value as seen from that distance.
    """
    state = cut(parents.select("v", F.col("parent").alias("up"), start.alias("value")))
    distance = 1
    while not state.where("up >= 0").isEmpty():
        below = state.where("up >= 0").groupBy(F.col("up").alias("v")).agg(combine(far(F.col("value"), distance)).alias("more"))
        above = state.select(F.col("v").alias("up"), F.col("up").alias("next"))
        value = combine_two(combine, F.col("value"), F.col("more"))
        state = cut(state.join(above, "up", "left").join(below, "v", "left").select("v", F.coalesce("next", F.lit(-1)).cast("long").alias("up"), value.alias("value")))
        distance *= 2
    return state.select("v", "value")


def combine_two(combine, a, b):
    """Two values as the aggregate would combine them; b may be null."""
    return F.greatest(a, F.coalesce(b, a)) if combine is F.max else a + F.coalesce(b, F.lit(0.0))


def subtree_costs(parents: DataFrame, cost: str) -> DataFrame:
    """v and the sum of costs in its subtree."""
    return _gathered(parents, F.col(cost).cast("double"), F.sum, lambda value, distance: value).withColumnRenamed("value", "cost")


def topological_levels(parents: DataFrame) -> DataFrame:
    """v and its level: 0 for leaves, else one more than its highest child's."""
    return _gathered(parents, F.lit(0), F.max, lambda value, distance: value + distance).select("v", F.col("value").cast("int").alias("lvl"))


def weight_parts(rows: DataFrame, parts: int, *order: str) -> DataFrame:
    """v, part: runs of the order with about equal weight; rows(v, w and the columns of the order, the last of which is v).

    Totals of ranges of 65536 ids are summed first, so that no window holds all rows.
    """
    lead = list(order[:-1])
    rows = rows.withColumn("range", F.expr("v div 65536"))
    totals = cut(rows.groupBy(*lead, "range").agg(F.sum("w").alias("t")))
    before = Window.orderBy(*lead, "range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*lead, "range", F.coalesce(F.sum("t").over(before), F.lit(0.0)).alias("base"))
    total = totals.agg(F.sum("t")).first()[0] or 1.0
    own = F.sum("w").over(Window.partitionBy(*lead, "range").orderBy("v"))
    placed = rows.withColumn("own", own).join(base, [*lead, "range"])
    return placed.select("v", F.least(F.lit(parts - 1), F.floor((F.col("base") + F.col("own") - F.col("w")) * parts / total)).cast("int").alias("part"))


def postorder_parts(parents: DataFrame, parts: int, weight: str | None = None) -> DataFrame:
    """v, part: consecutive runs of the order of levels with about equal weight."""
    levels = topological_levels(parents)
    rows = parents.join(levels, "v").select("v", "lvl", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    return weight_parts(rows, parts, "lvl", "v")
