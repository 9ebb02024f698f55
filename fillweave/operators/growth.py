"""Parts of a graph that grow from seeds at once, connected and of nearly one size.

Every part keeps a spanning tree: a vertex joins under a neighbour that is in the part, and only
leaves of a tree move to another part. So each part stays connected whatever moves. Graphs that a
task can hold are parted in one. Larger ones are coarsened to that size by connected groups, whose
parts are connected as well; where that fails they are parted by joins, a round for each ring of vertices.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Scratch, cut
from .coarsen import MERGED, RANGE, contracted, mutual, proposals, range_edges, range_groups
from .decompose import TASK_EDGES


def spread_seeds(vertices: DataFrame, parts: int) -> DataFrame:
    """v, part: as many vertices as parts, those of the smallest hashes."""
    first = vertices.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(parts).collect()
    return vertices.sparkSession.createDataFrame([(r["v"], k) for k, r in enumerate(first)], "v long, part int")


def _sizes(at: DataFrame) -> dict[int, int]:
    """One number for each part."""
    return {r["part"]: r["count"] for r in at.groupBy("part").count().collect()}


def _sized(at: DataFrame, sizes: dict[int, int], part: str, name: str) -> DataFrame:
    """With the size of the part named; a row for each part is broadcast."""
    rows = at.sparkSession.createDataFrame(list(sizes.items()), f"{part} int, {name} long")
    return at.join(F.broadcast(rows), part)


def _some(chosen: DataFrame, groups: list[str], wanted: F.Column, turn: int) -> DataFrame:
    """About `wanted` rows of each group, which `wanted` is the same for: by hashes, so that no group is sorted in one task."""
    counted = chosen.groupBy(*groups).agg(F.count("*").alias("n"))
    return chosen.join(F.broadcast(counted), groups).where(F.pmod(F.xxhash64("v", F.lit(turn)), F.col("n")) < wanted).drop("n")


def grown(scratch: Scratch, edges: DataFrame, seeds: DataFrame, cap: int) -> DataFrame:
    """v, part, parent: what the seeds reach, round by round; a vertex that several parts reach goes to the smallest.

    A part that has `cap` vertices waits until no other can grow; then all grow on to the end. Only
    edges from a part to what isn't in one are joined in a round, with the edges of the vertices
    that came in the round before.
    """
    new = scratch.table(seeds.select("v", "part", F.col("v").alias("parent")))
    found, turn, capped = [new], 0, True
    sizes = _sizes(new)
    border = None
    while True:
        ahead = edges.join(new.select(F.col("v").alias("u"), "part"), "u").join(new.select("v"), "v", "left_anti").select("u", "v", "part")
        if border is not None:
            # a neighbour that was in a part before has an edge to the new vertex in the border
            back = border.select(F.col("v").alias("u"), F.col("u").alias("v"))
            ahead = ahead.join(back, ["u", "v"], "left_anti").union(border.join(new.select("v"), "v", "left_anti"))
        border = scratch.table(ahead)
        while True:
            turn += 1
            chosen = _sized(border, sizes, "part", "size")
            if capped:
                chosen = chosen.where(F.col("size") < cap)
            best = chosen.groupBy("v").agg(F.min(F.struct("size", "part", "u")).alias("b")).select("v", "b.part", "b.size", F.col("b.u").alias("parent"))
            if capped:
                best = _some(best, ["part"], F.lit(cap) - F.col("size"), turn)
            new = scratch.table(best.select("v", "part", "parent"))
            more = _sizes(new)
            if more or not capped:
                break
            capped = False
        if not more:
            break
        sizes = {p: sizes.get(p, 0) + more.get(p, 0) for p in sizes}
        found.append(new)
        if len(found) == 16:
            found = [scratch.table(_all(found))]
    return scratch.table(_all(found))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def balanced(scratch: Scratch, at: DataFrame, edges: DataFrame, tolerance: float, rounds: int) -> DataFrame:
    """v, part, parent after leaves moved from larger parts to smaller ones beside them, until all sizes are near the mean.

    In a round a part gives each smaller neighbour about their difference by its number of
    neighbours, so that sizes even out as heat does. A leaf doesn't join under a vertex that moves
    itself. Ends as well where nothing can move, or after `rounds`.
    """
    for turn in range(rounds):
        sizes = _sizes(at)
        mean = sum(sizes.values()) / max(1, len(sizes))
        if not sizes or max(sizes.values()) <= (1 + tolerance) * mean and min(sizes.values()) >= (1 - tolerance) * mean:
            break
        leaves = at.join(at.where("v <> parent").select(F.col("parent").alias("v")).distinct(), "v", "left_anti")
        leaves = leaves.where("v <> parent").select("v", F.col("part").alias("a"))
        to = at.select(F.col("v").alias("u"), F.col("part").alias("b"))
        beside = scratch.table(edges.join(leaves, "v").join(to, "u").where("a <> b").select("v", "u", "a", "b"))
        near = beside.select("a", "b").distinct()
        near = near.union(near.select("b", "a")).distinct().groupBy("a").agg(F.count("*").alias("near"))
        down = _sized(_sized(beside, sizes, "a", "from"), sizes, "b", "into").where("`from` > into + 1").join(F.broadcast(near), "a")
        best = down.groupBy("v", "a", "from", "near").agg(F.min(F.struct("into", "b", "u")).alias("m")).select("v", "a", "from", "near", "m.into", "m.b", "m.u")
        wanted = F.ceil((F.col("from") - F.col("into")) / (F.col("near") + 1))
        asked = _some(best, ["a", "b"], wanted, turn).select("v", "u", "b")
        moves = scratch.table(asked.join(asked.select(F.col("v").alias("u")), "u", "left_anti"))
        if moves.isEmpty():
            break
        changed = at.join(moves, "v", "left").select("v", F.coalesce("b", "part").alias("part"), F.coalesce("u", "parent").alias("parent"))
        at = scratch.table(changed)
    return at


def coarsened(scratch: Scratch, nodes: DataFrame, edges: DataFrame, seeds: DataFrame, most: float, task_edges: int) -> tuple[list[DataFrame], DataFrame, DataFrame] | None:
    """(maps(v, to) from finer to coarser vertices, coarse nodes, coarse edges) of at most task_edges edges; None where merging stalls.

    nodes(hmd_id, v, w), edges(hmd_id, u, v, w). Groups are connected and weigh at most `most`; seeds stay
    alone, so that each part has its own.
    """
    maps, width, turn = [], RANGE, 0
    alone = seeds.select("v")
    while (total := edges.count()) > task_edges:
        before = nodes.count()
        free = edges.join(alone.withColumnRenamed("v", "u"), "u", "left_anti").join(alone, "v", "left_anti").select("hmd_id", "u", "v", "w")
        groups = None
        if width:
            inside = scratch.table(range_edges(free, width))
            if 2 * inside.count() >= total:
                groups = range_groups(nodes, inside, width, most)
            width = width * MERGED if groups is not None else 0
        by_range = groups is not None
        if not by_range:
            a, b = nodes.select(F.col("v").alias("a"), F.col("w").alias("wa")), nodes.select(F.col("v").alias("b"), F.col("w").alias("wb"))
            groups = mutual(proposals(free, turn)).join(a, "a").join(b, "b").where(F.col("wa") + F.col("wb") <= most).select(F.col("b").alias("v"), F.col("a").alias("to"))
        up, nodes, edges = contracted(nodes, edges, groups, scratch)
        maps.append(up)
        turn += 1
        left = nodes.count()
        if by_range and left > 0.6 * before:
            width = 0
        elif left > 0.95 * before:
            return None
    return maps, nodes, edges


def _by_groups(scratch: Scratch, all_v: DataFrame, near: DataFrame, seeds: DataFrame, parts: int, tolerance: float, task_edges: int) -> DataFrame | None:
    """v, part by way of a coarse graph that one task parts; None if there is none."""
    nodes = scratch.table(all_v.select(F.lit(0).alias("hmd_id"), "v", F.lit(1).cast("long").alias("w")))
    edges = scratch.table(near.select(F.lit(0).alias("hmd_id"), "u", "v", F.lit(1).cast("long").alias("w")))
    # a group is but a small share of what sizes may be off by
    found = coarsened(scratch, nodes, edges, seeds, tolerance * nodes.count() / parts / 4, task_edges)
    if found is None:
        return None
    maps, nodes, edges = found
    ends = edges.select(F.col("u").alias("v")).union(seeds.select("v")).distinct()
    rows = nodes.join(ends, "v", "left_semi").join(seeds, "v", "left").select("v", "w", "part").withColumn("one", F.lit(0))

    def run(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        first = s[s["part"].notna()].astype({"part": int}).sort_values(["part", "v"])
        return grown_in_task(e, first, tolerance, s.set_index("v")["w"])

    both = edges.select("u", "v").withColumn("one", F.lit(0)).groupBy("one").cogroup(rows.groupBy("one"))
    at = scratch.table(both.applyInPandas(run, "v long, part int"))
    for up in reversed(maps):
        at = scratch.table(up.join(at.withColumnRenamed("v", "to"), "to").select("v", "part"))
    return at


def grown_in_task(near: pd.DataFrame, seeds: pd.DataFrame, tolerance: float, weights: pd.Series | None = None) -> pd.DataFrame:
    """v, part of what the seeds reach, by the same rules vertex by vertex: the smallest part that can takes the next one.

    Where no leaf can move, trees are hung anew. Sizes are sums of weights by vertex, 1 each if none are given.
    """
    ids, ends = np.unique(np.concatenate([near["u"], near["v"], seeds["v"]]).astype(np.int64), return_inverse=True)
    u, v, first = ends[: len(near)], ends[len(near) : 2 * len(near)], ends[2 * len(near) :]
    order = np.lexsort((v, u))
    bounds = np.searchsorted(u[order], np.arange(len(ids) + 1))
    around = [x.tolist() for x in np.split(v[order], bounds[1:-1])]
    part, parent, below = [-1] * len(ids), [-1] * len(ids), [0] * len(ids)
    size, members, waiting = {}, {}, {}
    heft = [1] * len(ids) if weights is None else weights.reindex(ids).tolist()

    def take(x: int, p: int, under: int) -> None:
        part[x], parent[x] = p, under
        size[p], members[p] = size.get(p, 0) + heft[x], members.get(p, 0) + 1
        waiting.setdefault(p, deque()).extend((y, x) for y in around[x] if part[y] < 0)

    for x, p in zip(first.tolist(), seeds["part"].tolist(), strict=True):
        if part[x] < 0:
            take(x, p, x)
    heap = [(n, p) for p, n in size.items()]
    heapq.heapify(heap)
    while heap:
        _, p = heapq.heappop(heap)
        while waiting[p]:
            x, under = waiting[p].popleft()
            if part[x] < 0:
                take(x, p, under)
                below[under] += 1
                heapq.heappush(heap, (size[p], p))
                break
    def reached(x: int, without: int = -1) -> dict[int, int]:
        """Vertices of x's part in order of their distance from x, and the neighbour that each was reached by."""
        found, todo = {x: x}, deque([x])
        while todo:
            z = todo.popleft()
            for y in around[z]:
                if part[y] == part[x] and y not in found and y != without:
                    found[y] = z
                    todo.append(y)
        return found

    def rehung() -> bool:
        """Hang a part's tree anew so that a vertex beside a smaller part is a leaf, that of the largest difference that can be one."""
        steps = ((size[part[x]] - min(size[part[y]] for y in around[x] if part[y] >= 0), x) for x in range(len(ids)) if part[x] >= 0 and around[x])
        for _, x in sorted((k for k in steps if k[0] > heft[k[1]]), reverse=True):
            # from the far end, so that more leaves are on this side
            tree = reached(next(reversed(reached(x))), x)
            if len(tree) == members[part[x]] - 1:
                tree[x] = next(y for y in around[x] if y in tree)
                for y in tree:
                    below[y] = 0
                for y, under in tree.items():
                    parent[y] = under
                    below[under] += y != under
                return True
        return False

    mean, moved = sum(size.values()) / max(1, len(size)), True
    while moved and (max(size.values()) > (1 + tolerance) * mean or min(size.values()) < (1 - tolerance) * mean):
        moved = False
        for x in range(len(ids)):
            a = part[x]
            if a < 0 or below[x] or parent[x] == x:
                continue
            n, b, under = min(((size[part[y]], part[y], y) for y in around[x] if part[y] != a), default=(size[a], a, x))
            if size[a] > n + heft[x]:
                below[parent[x]] -= 1
                below[under] += 1
                part[x], parent[x], moved = b, under, True
                size[a], size[b] = size[a] - heft[x], n + heft[x]
                members[a], members[b] = members[a] - 1, members[b] + 1
        moved = moved or rehung()
    done = np.array(part)
    return pd.DataFrame({"v": ids[done >= 0], "part": done[done >= 0]})


def growth_partition(vertices: DataFrame, edges: DataFrame, parts: int, seeds: DataFrame | None = None, tolerance: float = 0.1, rounds: int = 200, task_edges: int = TASK_EDGES) -> DataFrame:
    """v, part: each part from 0 grows from one of the seeds(v, part), and is connected.

    Without seeds these are spread by hash; a seed itself may move to another part in the end.
    Sizes are within `tolerance` of their mean where moving leaves of the parts' trees can bring
    that about; beside each other parts may differ by one, so in a chain of small parts the ends may
    differ by their number. Vertices that no seed reaches have part -1; edges(u, v) hold both
    directions, and repeated ones count once. Without vertices there are no rows. `parts` is at most
    4096, as sizes of parts are held on the driver.
    """
    if not 1 <= parts <= 4096:
        raise ValueError("parts must be from 1 to 4096")
    with Scratch(vertices.sparkSession) as scratch:
        all_v = scratch.table(vertices.select(F.col("v").cast("long").alias("v")).distinct())
        near = scratch.table(edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct())
        first = spread_seeds(all_v, parts) if seeds is None else seeds.select(F.col("v").cast("long").alias("v"), F.col("part").cast("int").alias("part"))
        # of a seed or vertex that is named twice the first part counts
        first = scratch.table(first.join(all_v, "v", "left_semi").groupBy("v").agg(F.min("part").alias("part")))
        if near.count() <= task_edges:
            both = near.withColumn("one", F.lit(0)).groupBy("one").cogroup(first.withColumn("one", F.lit(0)).groupBy("one"))
            at = both.applyInPandas(lambda e, s: grown_in_task(e, s, tolerance), "v long, part int")
        elif (at := _by_groups(scratch, all_v, near, first, parts, tolerance, task_edges)) is None:
            at = balanced(scratch, grown(scratch, near, first, -(-all_v.count() // parts)), near, tolerance, rounds)
        return cut(all_v.join(at, "v", "left").select("v", F.coalesce("part", F.lit(-1)).alias("part")))
