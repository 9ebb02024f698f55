"""Bisection of graphs that no task can hold: multilevel coarsening by joins.

Vertices are merged along heavy edges, round by round, until each region's coarse graph fits into
a task, where a kernel parts it in two. Where most edges lead to near ids, a round merges groups of about
sixteen vertices within ranges of ids, a task for each; else it merges about two by joins. On the way back each finer graph takes its sides from the
coarser one and moves vertices of its border whose edges mostly lead across. The smaller border of
the finest graph is the separator. All regions are worked on at once; every round works on a
graph of little more than half the vertices of the last, or less. A region that takes several levels of
separators to fit a task is coarsened once: its coarse graph is parted in two again and again in the task.

Tables: nodes(hmd_id, v, w) and edges(hmd_id, u, v, w), w the number of vertices or edges that a
coarse one stands for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.lineage import Scratch, cut, large
from . import tree as T

#: Directed edges of a coarse graph that a task parts.
COARSE_EDGES = 100_000
#: The prime below which ids are scattered; ties between edges of equal weight are broken so.
PRIME = 1_000_003
#: Ids of a range whose vertices one task merges, and how many times as many the next round takes.
RANGE, MERGED = 1 << 16, 16
#: Directed edges within a range up to which a task merges it.
RANGE_EDGES = 4_000_000


def scattered(a: Column, b: Column, seed: int) -> Column:
    """A number below PRIME that a pair of ids, a <= b, gets in a round."""
    x = (F.pmod(a, F.lit(PRIME)) * 7919 + F.pmod(b, F.lit(PRIME)) * 104_729 + 15_485_863 * (seed + 1)) % PRIME
    return (x * x + x * 31) % PRIME


def proposals(edges: DataFrame, seed: int) -> DataFrame:
    """u, to: the neighbour that each vertex would merge with: along its heaviest edge, ties by scattered(), then the larger one."""
    tie = scattered(F.least("u", "v").cast("long"), F.greatest("u", "v").cast("long"), seed)
    return edges.groupBy("u").agg(F.max(F.struct("w", tie.alias("tie"), "v"))["v"].alias("to"))


def mutual(wishes: DataFrame) -> DataFrame:
    """a < b of the vertices that propose to each other."""
    pairs = wishes.groupBy(F.least("u", "to").alias("a"), F.greatest("u", "to").alias("b")).agg(F.count("*").alias("n"))
    return pairs.where("n = 2").select("a", "b")


def matching(edges: DataFrame, seed: int, scratch: Scratch, rounds: int = 2) -> DataFrame:
    """v, to: the smallest vertex of the group that each merged vertex belongs to.

    Pairs that propose to each other merge, in `rounds` rounds among those that are still free.
    What is then left merges with others that want the same neighbour, in groups of about two
    told by a hash: so a hub's many leaves merge with each other.
    """
    edges = large(edges)
    found, free = None, edges
    for k in range(rounds):
        pairs = mutual(proposals(free, rounds * seed + k))
        both = scratch.table(pairs.select(F.col("a").alias("v"), F.col("a").alias("to")).union(pairs.select(F.col("b").alias("v"), F.col("a").alias("to"))))
        found = large(both if found is None else found.union(both))
        if k < rounds - 1:
            taken = both.select("v")
            free = scratch.table(free.join(taken.withColumnRenamed("v", "u"), "u", "left_anti").join(taken, "v", "left_anti"))
    rest = scratch.table(proposals(edges, seed).join(found.select(F.col("v").alias("u")), "u", "left_anti"))
    wanted = rest.groupBy("to").agg(F.ceil(F.count("*") / 2).alias("groups"))
    rest = large(rest.join(wanted, "to").select(F.col("u").alias("v"), "to", F.pmod(F.xxhash64("u"), F.col("groups")).alias("g")))
    heads = rest.groupBy("to", "g").agg(F.min("v").alias("head"))
    return found.union(rest.join(heads, ["to", "g"]).select("v", F.col("head").alias("to")))


def range_edges(edges: DataFrame, width: int) -> DataFrame:
    """hmd_id, at, u, v, w of the edges within a range of ids; ranges of more than RANGE_EDGES are left out."""
    inside = edges.withColumn("at", F.expr(f"u div {width}")).where(f"at = v div {width}")
    few = inside.groupBy("hmd_id", "at").agg(F.count("*").alias("n")).where(F.col("n") <= RANGE_EDGES).drop("n")
    return large(inside).join(few, ["hmd_id", "at"], "left_semi").select("hmd_id", "at", "u", "v", "w")


def range_groups(nodes: DataFrame, inside: DataFrame, width: int, most: float = float("inf")) -> DataFrame:
    """v, to: the smallest vertex of the group that each one belongs to, groups of about MERGED in a range, a task for each range.

    Groups are connected, and those of several vertices weigh at most `most`.
    """

    def run(key, vertices: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        vertices = vertices.sort_values("v")
        ids = vertices["v"].to_numpy()
        u, v = np.searchsorted(ids, near["u"].to_numpy()), np.searchsorted(ids, near["v"].to_numpy())
        weight = vertices["w"].to_numpy().astype(float)
        return pd.DataFrame({"v": ids, "to": ids[kernels.merged(len(ids), u, v, near["w"].to_numpy().astype(float), weight, min(most, MERGED * weight.mean()))]})

    left = nodes.select(F.col("hmd_id").alias("region"), F.expr(f"v div {width}").alias("of"), "v", "w").groupBy("region", "of")
    right = inside.select(F.col("hmd_id").alias("near"), "at", "u", "v", "w").groupBy("near", "at")
    return large(left.cogroup(right).applyInPandas(run, "v long, to long"))


def contracted(nodes: DataFrame, edges: DataFrame, groups: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(map(v, to) of all nodes, coarse nodes, coarse edges) once the groups are merged."""
    to = scratch.table(nodes.join(groups, "v", "left").select("hmd_id", "v", F.coalesce("to", "v").alias("to"), "w"))
    up = to.select("v", "to")
    near = edges.join(up.select(F.col("v").alias("u"), F.col("to").alias("a")), "u").join(up.select("v", F.col("to").alias("b")), "v").where("a <> b")
    coarse = near.groupBy("hmd_id", F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("w").alias("w"))
    return up, scratch.table(to.groupBy("hmd_id", F.col("to").alias("v")).agg(F.sum("w").alias("w"))), scratch.table(coarse)


def _parted(nodes: DataFrame, edges: DataFrame, splits: int) -> DataFrame:
    """hmd_id, v, side of the vertices that have edges, a task for each region; sides are numbers of parts, below 2**splits."""

    def run(key, vertices: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        vertices = vertices.sort_values("v")
        ids = vertices["v"].to_numpy()
        u, v = np.searchsorted(ids, near["u"].to_numpy()), np.searchsorted(ids, near["v"].to_numpy())
        side = kernels.bisected(len(ids), u, v, near["w"].to_numpy().astype(float), vertices["w"].to_numpy().astype(float), splits)
        return pd.DataFrame({"hmd_id": key[0], "v": ids, "side": side})

    joined = nodes.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    left = joined.select(F.col("hmd_id").alias("region"), "v", "w").groupBy("region")
    right = edges.select(F.col("hmd_id").alias("near"), "u", "v", "w").groupBy("near")
    return left.cogroup(right).applyInPandas(run, "hmd_id int, v long, side byte")


def _unlinked(nodes: DataFrame, sides: DataFrame) -> DataFrame:
    """hmd_id, v, side: sides with those of the nodes that have none, which are dealt out by a hash so that both sides weigh about the same."""
    known = nodes.join(sides.select("v", "side"), "v", "left")
    total = known.groupBy("hmd_id").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("side") == 0, F.col("w")).otherwise(0)).alias("zero"), F.sum(F.when(F.col("side").isNull(), F.col("w")).otherwise(0)).alias("open"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("all") / 2 - F.col("zero"), F.col("open"))))
    total = F.broadcast(total.select("hmd_id", F.coalesce(share, F.lit(0.0)).alias("share")))  # a row for each tree node
    dealt = F.when(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < F.col("share") * (1 << 20), 0).otherwise(1)
    return known.join(total, "hmd_id").select("hmd_id", "v", F.coalesce("side", dealt).cast("byte").alias("side"))


def refined(nodes: DataFrame, edges: DataFrame, sides: DataFrame, scratch: Scratch, turns: int = 2, least_share: float = 0.42) -> DataFrame:
    """sides(hmd_id, v, side) after `turns` rounds of moves across, from the heavier side and from the lighter one in turn.

    In a round all vertices of one side move that have more weight of edges across than within;
    as they go the same way, none spoils another's gain. No side gets lighter than least_share:
    if the movers weigh too much, those stay that a hash says.
    """
    for turn in range(turns):
        a, b = sides.select(F.col("v").alias("u"), F.col("side").alias("su")), sides.select("v", F.col("side").alias("sv"))
        near = edges.join(a, "u").join(b, "v")
        gain = near.groupBy(F.col("u").alias("v")).agg(F.sum(F.when(F.col("su") != F.col("sv"), F.col("w")).otherwise(-F.col("w"))).alias("gain"))
        state = scratch.table(sides.join(nodes.select("v", "w"), "v").join(gain.where("gain > 0"), "v", "left"))
        on = lambda side, x=F.col("w"): F.sum(F.when(F.col("side") == side, x).otherwise(0))
        total = state.groupBy("hmd_id").agg(on(0).alias("w0"), on(1).alias("w1"), *(on(s, F.when(F.col("gain").isNotNull(), F.col("w")).otherwise(0)).alias(f"m{s}") for s in (0, 1)))
        heavy = F.when(F.col("w0") >= F.col("w1"), 0).otherwise(1)
        way = heavy if turn % 2 == 0 else 1 - heavy
        weight, movers = F.when(way == 0, F.col("w0")).otherwise(F.col("w1")), F.when(way == 0, F.col("m0")).otherwise(F.col("m1"))
        spare = F.greatest(F.lit(0.0), weight - least_share * (F.col("w0") + F.col("w1")))
        total = F.broadcast(total.select("hmd_id", way.alias("way"), F.coalesce(F.try_divide(spare, movers), F.lit(1.0)).alias("share")))  # a row for each tree node
        goes = F.col("gain").isNotNull() & (F.col("side") == F.col("way")) & (F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(1 << 20)) < F.col("share") * (1 << 20))
        sides = scratch.table(state.join(total, "hmd_id").select("hmd_id", "v", F.when(goes, 1 - F.col("side")).otherwise(F.col("side")).cast("byte").alias("side")))
    return sides


def _spread(nodes: DataFrame, sides: DataFrame, splits: int) -> DataFrame:
    """hmd_id, v, side: sides with those of the nodes that have none, which go to parts by a hash."""
    dealt = F.pmod(F.xxhash64("v"), F.lit(1 << splits))
    return nodes.join(sides.select("v", "side"), "v", "left").select("hmd_id", "v", F.coalesce("side", dealt).cast("byte").alias("side"))


def refined_parts(nodes: DataFrame, edges: DataFrame, sides: DataFrame, splits: int, scratch: Scratch, turns: int = 2, least_share: float = 0.84) -> DataFrame:
    """sides(hmd_id, v, side) of 2**splits parts after `turns` rounds of moves, to parts of higher numbers and of lower ones in turn.

    A vertex moves to the part that most of its edges' weight leads to, if that is more than leads to its
    own. No part gets lighter than least_share of the mean: if its movers weigh too much, those stay that a hash says.
    """
    for turn in range(turns):
        far = edges.select("u", "v", "w").join(sides.select("v", F.col("side").alias("to")), "v").groupBy(F.col("u").alias("v"), "to").agg(F.sum("w").alias("w"))
        known = far.join(sides.select("v", F.col("side").alias("own")), "v")
        ahead = (F.col("to") > F.col("own")) if turn % 2 == 0 else (F.col("to") < F.col("own"))
        best = known.groupBy("v").agg(F.max(F.when(ahead, F.struct("w", "to"))).alias("best"), F.max(F.when(F.col("to") == F.col("own"), F.col("w")).otherwise(0)).alias("held"))
        moves = best.where("best.w > held").select("v", F.col("best.to").alias("to"))
        state = scratch.table(sides.join(nodes.select("v", "w"), "v").join(moves, "v", "left"))
        total = state.groupBy("hmd_id", "side").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("to").isNotNull(), F.col("w")).otherwise(0)).alias("movers"))
        mean = total.groupBy("hmd_id").agg((F.sum("all") / (1 << splits)).alias("mean"))
        spare = F.greatest(F.lit(0.0), F.col("all") - least_share * F.col("mean"))
        share = total.join(F.broadcast(mean), "hmd_id").select("hmd_id", "side", F.coalesce(F.try_divide(spare, F.col("movers")), F.lit(1.0)).alias("share"))  # a row for each part
        goes = F.col("to").isNotNull() & (F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(1 << 20)) < F.col("share") * (1 << 20))
        sides = scratch.table(state.join(F.broadcast(share), ["hmd_id", "side"]).select("hmd_id", "v", F.when(goes, F.col("to")).otherwise(F.col("side")).cast("byte").alias("side")))
    return sides


def bisected(nodes: DataFrame, edges: DataFrame, scratch: Scratch, coarse_edges: int = COARSE_EDGES, splits: int = 1) -> DataFrame:
    """hmd_id, v, side (0 or 1, or with more splits a part below 2**splits) of all nodes, by coarsening, a kernel, and refinement on the way back."""
    levels, seed, width = [], 0, RANGE
    while True:
        sizes = edges.groupBy("hmd_id").agg(F.count("*").alias("n")).where(F.col("n") > coarse_edges)
        open_regions = {r["hmd_id"]: r["n"] for r in sizes.collect()}  # tree nodes
        total = sum(open_regions.values())
        if not total:
            break
        some = T.among("hmd_id", open_regions)
        before, mine = nodes.count(), edges.where(some)
        groups = None
        if width:
            inside = scratch.table(range_edges(mine, width))
            if 2 * inside.count() >= total:
                groups = range_groups(nodes.where(some), inside, width)
            width = width * MERGED if groups is not None else 0
        by_range = groups is not None
        up, coarse, between = contracted(nodes, edges, groups if by_range else matching(mine, seed, scratch), scratch)
        levels.append((nodes, edges, up))
        nodes, edges, seed = coarse, between, seed + 1
        left = nodes.count()
        if by_range and left > 0.6 * before:
            width = 0  # a hub's leaves, for one, have nothing to merge with in a range
        elif left > 0.98 * before:
            break  # so dense that merging doesn't help: the kernel takes it as it is
    parted = scratch.table(_parted(nodes, edges, splits))
    sides = scratch.table(_unlinked(nodes, parted) if splits == 1 else _spread(nodes, parted, splits))
    for fine, near, up in reversed(levels):
        own = up.join(sides.select(F.col("v").alias("to"), "hmd_id", "side"), "to").select("hmd_id", "v", "side")
        own = scratch.table(own)
        sides = refined(fine, near, own, scratch) if splits == 1 else refined_parts(fine, near, own, splits, scratch)
    return sides


def separated(sides: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """hmd_id, v, side with 2 for the separator: of the two borders between sides 0 and 1 the one of fewer vertices."""
    a, b = sides.select(F.col("v").alias("u"), F.col("side").alias("su")), sides.select("v", F.col("side").alias("sv"))
    border = scratch.table(edges.join(a, "u").join(b, "v").where("su <> sv").select("hmd_id", F.col("u").alias("v"), F.col("su").alias("side")).distinct())
    size = border.groupBy("hmd_id").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(-1)).alias("more"))
    chosen = border.join(F.broadcast(size), "hmd_id").where("side = if(more <= 0, 0, 1)").select("v", F.lit(True).alias("cut"))  # tree nodes
    return sides.join(chosen, "v", "left").select("hmd_id", "v", F.when(F.col("cut"), 2).otherwise(F.col("side")).cast("byte").alias("side"))


def coarse_separators(regions: DataFrame, inside: DataFrame, coarse_edges: int = COARSE_EDGES) -> DataFrame:
    """hmd_id, v, side (0 left, 1 right, 2 separator) of regions(hmd_id, v) with their edges inside(hmd_id, u, v)."""
    with Scratch(regions.sparkSession) as scratch:
        nodes = scratch.table(regions.select("hmd_id", F.col("v").cast("long").alias("v"), F.lit(1).cast("long").alias("w")))
        edges = scratch.table(inside.select("hmd_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.lit(1).cast("long").alias("w")))
        return cut(separated(bisected(nodes, edges, scratch, coarse_edges), edges, scratch))


def coarse_parts(regions: DataFrame, inside: DataFrame, splits: int, coarse_edges: int = COARSE_EDGES) -> DataFrame:
    """v, to, end: the tree node of each vertex of regions(hmd_id, v) after `splits` levels of separators, and whether it is one of a separator.

    Of the two borders that the parts left and right of a node have with each other that of fewer vertices is
    the node's separator; a vertex in several separators is in the highest. So every edge between parts has an
    end in the separator of their common ancestor, or of one above it.
    """
    with Scratch(regions.sparkSession) as scratch:
        nodes = scratch.table(regions.select("hmd_id", F.col("v").cast("long").alias("v"), F.lit(1).cast("long").alias("w")))
        edges = scratch.table(inside.select("hmd_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.lit(1).cast("long").alias("w")))
        leaf = ((F.col("hmd_id") + 1) * (1 << splits) - 1 + F.col("side")).cast("int")
        sides = scratch.table(bisected(nodes, edges, scratch, coarse_edges, splits).select("v", leaf.alias("to")))
        a, b = sides.select(F.col("v").alias("u"), F.col("to").alias("a")), sides.select("v", F.col("to").alias("b"))
        across = edges.select("u", "v").join(a, "u").join(b, "v").where("a <> b")
        border = scratch.table(across.select(T.common_ancestor("a", "b").alias("node"), F.col("u").alias("v"), (F.col("a") < F.col("b")).alias("left")).distinct())
        less = border.groupBy("node").agg(F.sum(F.when(F.col("left"), 1).otherwise(-1)).alias("more"))
        chosen = border.join(F.broadcast(less), "node").where("left = (more <= 0)").groupBy("v").agg(F.min("node").alias("node"))  # tree nodes
        return cut(sides.join(chosen, "v", "left").select(F.col("v").cast("int").alias("v"), F.coalesce("node", "to").cast("int").alias("to"), F.col("node").isNotNull().alias("end")))
