"""Decomposition of a graph into a binary tree of vertex separators, level by level.

State: `regions(v, hmd_id)` says which tree node each vertex is at. In each level all open
regions are split at once: those of many edges by multilevel coarsening (coarsen.py), smaller ones
by the level structure of a breadth-first search inside a grouped task, which goes down all levels
that are left. Coarsening goes down as many levels at once as it takes until a task holds a part. Either way no edge joins the two halves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import kernels
from ..plans.lineage import cut
from . import mesh as M
from . import tree as T
from .coarsen import COARSE_EDGES, coarse_parts, coarse_separators
from .elimination import minimum_degree_labels

METHODS = ("nested", "mindegree")
#: Edges up to which one task orders a region, which takes Python work for each vertex.
TASK_EDGES = 400_000
#: How many times as many edges a task parts, by a few sweeps in numpy; more go by rounds of joins, which cost jobs.
PARTED = 10
#: Levels of separators that one coarsening gives, at most.
MOST_SPLITS = 5


def _local(vertices: pd.DataFrame, edges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.sort(vertices["v"].to_numpy())
    return ids, np.searchsorted(ids, edges["u"].to_numpy()), np.searchsorted(ids, edges["v"].to_numpy())


def _per_region(vertices: DataFrame, edges: DataFrame, run, schema: str) -> DataFrame:
    """run(key, vertices(region, v), edges(near, u, v)) for each region, as a grouped task."""
    left = vertices.select(F.col("hmd_id").alias("region"), "v").groupBy("region")
    right = edges.select(F.col("hmd_id").alias("near"), F.col("u").alias("u"), F.col("v").alias("v")).groupBy("near")
    return left.cogroup(right).applyInPandas(run, schema)


def _split_small(key, vertices: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    ids, u, v = _local(vertices, edges)
    return pd.DataFrame({"hmd_id": key[0], "v": ids, "side": kernels.level_separator(len(ids), u, v)})


def _descended(vertices: DataFrame, edges: DataFrame, levels: int) -> DataFrame:
    """v, to: the node that each vertex of these regions ends at, all levels of a region in one task."""

    def run(key, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        ids, u, v = _local(own, near)
        return pd.DataFrame({"v": ids, "to": kernels.dissected(len(ids), u, v, int(key[0]), levels)})

    return _per_region(vertices, edges, run, "v int, to int")


def edge_counts(inside: DataFrame) -> dict[int, int]:
    """The number of edges of each tree node that has any; inside is region_edges()."""
    return {r["hmd_id"]: r["n"] for r in inside.groupBy("hmd_id").agg(F.count("*").alias("n")).collect()}


def separators(regions: DataFrame, inside: DataFrame, task_edges: int = PARTED * TASK_EDGES, counts: dict[int, int] | None = None) -> DataFrame:
    """hmd_id, v, side (0 left, 1 right, 2 separator) of all regions that have edges.

    inside is region_edges(): hmd_id, u, v; counts are its edge_counts(), if known.
    """
    counts = edge_counts(inside) if counts is None else counts
    small, large = [k for k, n in counts.items() if n <= task_edges], [k for k, n in counts.items() if n > task_edges]
    few = T.among("hmd_id", small)
    cuts = _per_region(regions.where(few).select("hmd_id", "v"), inside.where(few), _split_small, "hmd_id int, v int, side byte")
    if not large:
        return cuts
    few = T.among("hmd_id", large)
    split = coarse_separators(regions.where(few), inside.where(few), min(task_edges, COARSE_EDGES))
    split = split.select("hmd_id", F.col("v").cast("int").alias("v"), "side")
    return cuts.union(split) if small else split


def decompose(regions: DataFrame, edges: DataFrame, levels: int, task_edges: int = PARTED * TASK_EDGES) -> DataFrame:
    """Split regions down to `levels` levels below the root; returns the final (v, hmd_id).

    regions starts as all vertices at node 0, or as those of some subtrees at their tops. A
    region without edges, or at the last level, stays as it is.
    """
    state = cut(regions.select(F.col("v").cast("int").alias("v"), F.col("hmd_id").cast("int").alias("hmd_id"), F.lit(False).alias("closed")))
    near = edges
    for depth in range(levels):
        here = state.where(~F.col("closed") & (T.level("hmd_id") == depth))
        if here.isEmpty():
            continue
        # edges that no open region has now are in none below it, so the next level needs only these
        near = cut(M.region_edges(near, state.where(~F.col("closed"))))
        inside = near.where(T.level("hmd_id") == depth)
        near = near.select("u", "v")
        counts = edge_counts(inside)
        if not counts:
            continue
        rest = {k: n for k, n in counts.items() if n > task_edges}
        whole, to = T.among("hmd_id", counts.keys() - rest.keys()), None
        if len(rest) < len(counts):
            to = _descended(here.where(whole), inside.where(whole), levels).withColumn("end", F.lit(True))
        if rest:
            few = T.among("hmd_id", rest)
            splits = min(levels - depth, MOST_SPLITS, math.ceil(math.log2(max(rest.values()) / task_edges)))
            if splits > 1:
                parted = coarse_parts(here.where(few), inside.where(few), splits, min(task_edges, COARSE_EDGES))
            else:
                sides = separators(here.where(few), inside.where(few), task_edges, rest)
                at = F.when(F.col("side") == 0, 2 * F.col("hmd_id") + 1).when(F.col("side") == 1, 2 * F.col("hmd_id") + 2).otherwise(F.col("hmd_id"))
                parted = sides.select("v", at.cast("int").alias("to"), (F.col("side") == 2).alias("end"))
            to = parted if to is None else to.union(parted)
        closed = F.col("closed") | F.coalesce("end", T.level("hmd_id") == depth)
        state = cut(state.join(to, "v", "left").select("v", F.coalesce("to", "hmd_id").alias("hmd_id"), closed.alias("closed")))
    return state.select("v", "hmd_id")


def local_orders(regions: DataFrame, edges: DataFrame, method: str = "nested", task_edges: int = TASK_EDGES, depth: int | None = None) -> DataFrame:
    """hmd_id, v, label: each region's own elimination order as labels from 0.

    A region without edges keeps the order of its ids. One of too many edges for a task is
    decomposed further first, if it is at `depth`, the level of the tree's leaves, and its parts are
    ordered by the method; else it is ordered by minimum degree by joins.
    """
    if method not in METHODS:
        raise ValueError(f"no such ordering method: {method}")
    inside = cut(M.region_edges(edges, regions))
    large = {k: n for k, n in edge_counts(inside).items() if n > task_edges}
    at_depth = [k for k in large if (k + 1).bit_length() - 1 == depth]
    rest = large.keys() - at_depth

    def order(key, vertices: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        ids, u, v = _local(vertices, near)
        kernel = kernels.nested_dissection if method == "nested" else kernels.minimum_degree
        return pd.DataFrame({"hmd_id": key[0], "v": ids[kernel(len(ids), u, v)], "label": np.arange(len(ids))})

    few = T.among("hmd_id", large)
    own = regions.select("hmd_id", "v")
    out = _per_region(own.where(~few), inside.where(~few), order, "hmd_id int, v int, label int")
    if rest:
        some = T.among("hmd_id", rest)
        labels = minimum_degree_labels(own.where(some), inside.where(some), task_edges)
        out = out.union(labels.select("hmd_id", F.col("v").cast("int").alias("v"), F.col("label").cast("int").alias("label")))
    if at_depth:
        some, most = T.among("hmd_id", at_depth), max(large[k] for k in at_depth)
        out = out.union(_deeper_orders(own.where(some), inside.where(some), depth, math.ceil(math.log2(most / task_edges)) + 1, method, task_edges))
    return out


def _deeper_orders(own: DataFrame, inside: DataFrame, depth: int, extra: int, method: str, task_edges: int) -> DataFrame:
    """hmd_id, v, label of leaves at `depth`, by `extra` levels of separators below each of them.

    The parts below a leaf have node numbers of their own, as nothing else is there; a leaf's
    labels are those of its parts one after another, in post-order.
    """
    parts = cut(decompose(own, inside.select("u", "v"), depth + extra, PARTED * task_edges))
    labels = local_orders(parts, inside.select("u", "v"), method, task_edges)
    leaf = T.ancestor_at("hmd_id", F.lit(depth))
    sizes = parts.groupBy("hmd_id").agg(F.count("*").alias("size")).withColumn("leaf", leaf)
    order = Window.partitionBy("leaf").orderBy(T.postorder("hmd_id", depth + extra)).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("leaf", "hmd_id", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("base"))
    return labels.join(F.broadcast(base), "hmd_id").select(F.col("leaf").alias("hmd_id"), "v", (F.col("base") + F.col("label")).cast("int").alias("label"))


def tree_nodes(regions: DataFrame, levels: int) -> DataFrame:
    """hmd_node rows: level, parent, children that have vertices below them, offset and size."""
    sizes = regions.groupBy("hmd_id").agg(F.count("*").alias("size"))
    placed = T.with_offsets(sizes, levels)
    up = sizes.select(F.explode(F.sequence(F.lit(0), T.level("hmd_id"))).alias("d"), "hmd_id").select(T.ancestor_at("hmd_id", F.col("d")).alias("hmd_id")).distinct()
    offsets = up.join(placed, "hmd_id", "left").select("hmd_id", F.coalesce("size", F.lit(0)).alias("size"))
    nodes = T.with_offsets(offsets, levels)
    has = lambda k: up.select(F.expr(f"cast((hmd_id - {k}) div 2 as int)").alias("hmd_id"), F.col("hmd_id").alias("child")).where(F.expr(f"child > 0 and child % 2 = {k % 2}"))
    left, right = has(1).select("hmd_id", F.col("child").alias("left_id")), has(2).select("hmd_id", F.col("child").alias("right_id"))
    return (
        nodes.join(left, "hmd_id", "left")
        .join(right, "hmd_id", "left")
        .select("hmd_id", T.level("hmd_id").alias("level"), T.parent("hmd_id").alias("parent_id"), F.coalesce("left_id", F.lit(-1)).alias("left_id"), F.coalesce("right_id", F.lit(-1)).alias("right_id"), "node_offset", "size")
    )


def assembled(dof: DataFrame, nodes: DataFrame) -> DataFrame:
    """The permutation: new_pos = label + its node's offset. dof(hmd_id, v, label)."""
    at = F.broadcast(nodes.select("hmd_id", "node_offset"))  # at most 2**13 rows
    return dof.join(at, "hmd_id").select((F.col("label") + F.col("node_offset")).cast("int").alias("new_pos"), "v")


def violations(regions: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are in different regions of which neither is above the other."""
    both = M.edge_regions(edges, regions)
    return both.where((F.col("ru") != F.col("rv")) & ~T.is_separator(F.least("ru", "rv"), F.greatest("ru", "rv")))


def kway(regions: DataFrame, edges: DataFrame, levels: int) -> DataFrame:
    """v, part: a partition into 2**levels parts; separator vertices join the part below them
    that has the smallest number among their neighbours' (part 0 if none has)."""
    deep = decompose(regions, edges, levels)
    first = F.lit(T.first_of_level(levels))
    leaf = deep.where(T.level("hmd_id") == levels).select("v", (F.col("hmd_id") - first).alias("part"))
    near = edges.join(leaf.withColumnRenamed("part", "p"), "v").groupBy(F.col("u").alias("v")).agg(F.min("p").alias("p"))
    return deep.join(leaf, "v", "left").join(near, "v", "left").select("v", F.coalesce("part", "p", F.lit(0)).cast("int").alias("part"))

