"""Minimum degree by joins, for regions that no task can hold.

The graph that is left after some eliminations is kept as a quotient graph: `plain` edges between
vertices, and `members(e, v)` of elements, where element e is the clique of neighbours that vertex
e had when it was eliminated. Vertices are grouped into domains by coarsening, and those whose
neighbours are all in their domain are eliminated by minimum degree there, a task for each domain;
domains then merge to larger ones, until a task can hold what is left or most vertices stand between
domains. Of these rounds of joins eliminate some: the vertices of about the least degree are candidates;
those of them that no neighbour comes before, in an order of degree and a hash, go at
once, as no two of them touch. What is left once a region fits into a task is ordered there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.lineage import Scratch, cut
from .coarsen import MERGED, contracted, matching

#: Vertices of a domain, at most.
DOMAIN = 8192
#: Directed edges of a coarse graph whose vertices one task groups; more are merged by joins first.
GROUPED = 1_000_000
#: Rows of a quotient graph that are left to one task, if it may hold so many; more go on to larger domains.
LEFT = 20_000
#: A candidate's degree is at most this times the least one, or one more.
NEAR_LEAST = 1.2


def degrees(vertices: DataFrame, plain: DataFrame, members: DataFrame) -> DataFrame:
    """hmd_id, v, degree: plain neighbours, and the others in each element; what two elements share counts twice."""
    others = members.groupBy("e").agg((F.count("*") - 1).alias("others"))
    by_element = members.join(others, "e").groupBy("v").agg(F.sum("others").alias("b"))
    by_edge = plain.groupBy(F.col("u").alias("v")).agg(F.count("*").alias("a"))
    degree = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))
    return vertices.join(by_edge, "v", "left").join(by_element, "v", "left").select("hmd_id", "v", degree.cast("long").alias("degree"))


def independent(rated: DataFrame, plain: DataFrame, members: DataFrame, turn: int) -> DataFrame:
    """hmd_id, v: candidates of low degree, no two of which are neighbours."""
    least = F.broadcast(rated.groupBy("hmd_id").agg(F.min("degree").alias("least")))  # a row for each tree node
    near = rated.join(least, "hmd_id").where(F.col("degree") <= F.greatest(F.col("least") + 1, F.floor(F.col("least") * NEAR_LEAST)))
    found = near.select("hmd_id", "v", F.struct("degree", F.xxhash64("v", F.lit(turn)).alias("h"), "v").alias("place"))
    first = members.join(found.select("v", "place"), "v").groupBy("e").agg(F.min("place").alias("first"))
    late = members.join(found.select("v", "place"), "v").join(first, "e").where("place > first").select("v")
    a, b = found.select(F.col("v").alias("u"), F.col("place").alias("pu")), found.select("v", F.col("place").alias("pv"))
    late = late.union(plain.join(a, "u").join(b, "v").where("pu > pv").select(F.col("u").alias("v")))
    return found.select("hmd_id", "v").join(late.distinct(), "v", "left_anti").select("hmd_id", "v")


def eliminated(chosen: DataFrame, plain: DataFrame, members: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(plain, members) once the chosen vertices, no two of them neighbours, are eliminated.

    Elements that a chosen vertex is in become part of its own; edges within a new element go.
    """
    gone = chosen.select("v")
    absorbed = members.join(gone, "v", "left_semi").select("e", F.col("v").alias("by"))
    reach = plain.join(gone.withColumnRenamed("v", "u"), "u", "left_semi").select("hmd_id", F.col("u").alias("e"), "v")
    inherited = members.join(absorbed, "e").where("v <> by").select("hmd_id", F.col("by").alias("e"), "v")
    fresh = scratch.table(reach.union(inherited).distinct())
    rest = plain.join(gone.withColumnRenamed("v", "u"), "u", "left_anti").join(gone, "v", "left_anti")
    covered = rest.join(fresh.select("e", F.col("v").alias("u")), "u").join(fresh.select("e", "v"), ["e", "v"]).select("u", "v").distinct()
    old = members.join(absorbed.select("e").distinct(), "e", "left_anti")
    return scratch.table(rest.join(covered, ["u", "v"], "left_anti").select("hmd_id", "u", "v")), scratch.table(old.select("hmd_id", "e", "v").union(fresh))


def interior(vertices: DataFrame, plain: DataFrame, members: DataFrame) -> DataFrame:
    """hmd_id, v that are in one element and have no plain edge: once that element's vertex is eliminated they add no fill."""
    once = members.groupBy("v").agg(F.count("*").alias("n")).where("n = 1").select("v")
    return vertices.join(once, "v", "left_semi").join(plain.select(F.col("u").alias("v")), "v", "left_anti").select("hmd_id", "v")


def _rest(vertices: DataFrame, plain: DataFrame, members: DataFrame) -> DataFrame:
    """hmd_id, v, label of what is left of each region, a task for each."""

    def run(key, rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(rows["v"].to_numpy())
        at = np.searchsorted(ids, near["v"].to_numpy())
        edge = near["kind"].to_numpy() == 0
        groups = [np.array(x) for _, x in pd.Series(at[~edge]).groupby(near["x"].to_numpy()[~edge])]
        order = kernels.eliminated_inside(len(ids), np.searchsorted(ids, near["x"].to_numpy()[edge]), at[edge], groups, np.ones(len(ids), dtype=bool))[0]
        return pd.DataFrame({"hmd_id": key[0], "v": ids[order], "label": np.arange(len(ids))})

    both = plain.select("hmd_id", F.col("u").alias("x"), "v", F.lit(0).alias("kind")).union(members.select("hmd_id", "e", "v", F.lit(1)))
    left = vertices.select(F.col("hmd_id").alias("region"), "v").groupBy("region")
    return left.cogroup(both.select(F.col("hmd_id").alias("near"), "x", "v", "kind").groupBy("near")).applyInPandas(run, "hmd_id int, v long, label long")


def domains(nodes: DataFrame, edges: DataFrame, most: float, scratch: Scratch) -> DataFrame:
    """v, to: the smallest vertex of the group that each of nodes(hmd_id, v, w) is in, groups that weigh about `most`.

    edges(hmd_id, u, v, w) are merged along by joins until one task can group the coarse vertices. Vertices
    without edges are dealt out to groups below 0, which are of nothing but such vertices.
    """
    linked = nodes.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("hmd_id", "v", "w")
    single = nodes.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_anti")
    maps, turn, fine = [], 0, None
    while edges.count() > GROUPED:
        up, linked, edges = contracted(linked, edges, matching(edges, turn, scratch), scratch)
        maps.append(up)
        turn += 1
        before, fine = fine, linked.count()
        if before is not None and fine > 0.95 * before:
            break  # so dense that no more merge: what there is has to do

    def run(key, vertices: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        vertices = vertices.sort_values("v")
        ids = vertices["v"].to_numpy()
        u, v = np.searchsorted(ids, near["u"].to_numpy()), np.searchsorted(ids, near["v"].to_numpy())
        return pd.DataFrame({"v": ids, "to": ids[kernels.merged(len(ids), u, v, near["w"].to_numpy().astype(float), vertices["w"].to_numpy().astype(float), most)]})

    to = linked.select("v", F.col("v").alias("to"))
    few = edges.groupBy("hmd_id").agg(F.count("*").alias("n")).where(F.col("n") <= 2 * GROUPED).select("hmd_id")
    left = linked.join(F.broadcast(few), "hmd_id", "left_semi").select(F.col("hmd_id").alias("region"), "v", "w").groupBy("region")  # tree nodes
    right = edges.join(F.broadcast(few), "hmd_id", "left_semi").select(F.col("hmd_id").alias("near"), "u", "v", "w").groupBy("near")
    grouped = scratch.table(left.cogroup(right).applyInPandas(run, "v long, to long"))
    to = to.join(grouped.withColumnRenamed("to", "top"), "v", "left").select("v", F.coalesce("top", "to").alias("to"))
    for up in reversed(maps):
        to = scratch.table(up.join(to.select(F.col("v").alias("to"), F.col("to").alias("top")), "to").select("v", F.col("top").alias("to")))
    dealt = -1 - F.pmod(F.xxhash64("v"), F.lit(1 + int(nodes.count() // most)))
    return scratch.table(to.union(single.select("v", dealt.cast("long"))))


def by_domains(at: DataFrame, plain: DataFrame, members: DataFrame, most_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(gone(hmd_id, dom, place, v), at, plain, members) once the vertices are eliminated all of whose neighbours are in their domain.

    at(hmd_id, v, dom); elements lie within domains. A domain's task gets it with its border, whose vertices
    stay; domains of more than `most_rows` rows stay as they are.
    """
    ends = at.select(F.col("v").alias("u"), F.col("dom").alias("du")), at.select("v", F.col("dom").alias("dv"))
    both = scratch.table(plain.join(ends[0], "u").join(ends[1], "v").select("hmd_id", "u", "v", "du", "dv"))
    across = both.where("du <> dv").select("hmd_id", "u", "v")
    border = across.select(F.col("u").alias("v")).distinct().withColumn("border", F.lit(True))
    free = at.join(border, "v", "left").select("hmd_id", "dom", F.lit(0).alias("kind"), F.col("border").isNull().cast("long").alias("a"), F.col("v").alias("b"))
    inside = both.where("du = dv").select("hmd_id", "du", F.lit(1), "u", "v")
    elements = members.join(at.select("v", "dom"), "v").select("hmd_id", "dom", F.lit(2), "e", "v")
    rows = scratch.table(free.union(inside).union(elements))
    some = rows.groupBy("hmd_id", "dom").agg(F.count("*").alias("n")).where(F.col("n") <= most_rows).select("hmd_id", "dom")

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        kind, a, b = (rows[c].to_numpy() for c in ("kind", "a", "b"))
        own = kind == 0
        ids = np.sort(b[own])
        inner = np.zeros(len(ids), dtype=bool)
        inner[np.searchsorted(ids, b[own])] = a[own] == 1
        named = pd.Series(np.searchsorted(ids, b[kind == 2])).groupby(a[kind == 2])
        names = [e for e, _ in named]
        u, v = np.searchsorted(ids, a[kind == 1]), np.searchsorted(ids, b[kind == 1])
        order, near, left = kernels.eliminated_inside(len(ids), u, v, [np.array(x) for _, x in named], inner)
        gone = np.array(order, dtype=np.int64)
        left_u = np.repeat(np.arange(len(ids)), [len(x) for x in near])
        left_v = np.array([y for x in near for y in x], dtype=np.int64)
        named_by = [ids[k] if k < len(ids) else names[k - len(ids)] for k in left]
        left_e = np.repeat(np.array(named_by, dtype=np.int64), [len(x) for x in left.values()])
        left_m = np.array([y for x in left.values() for y in x], dtype=np.int64)
        columns = [(np.arange(len(gone)), ids[gone]), (ids[left_u], ids[left_v]), (left_e, ids[left_m])]
        out = [pd.DataFrame({"hmd_id": key[0], "dom": key[1], "kind": k, "a": x, "b": y}) for k, (x, y) in enumerate(columns)]
        return pd.concat(out, ignore_index=True)

    done = rows.join(some, ["hmd_id", "dom"], "left_semi").groupBy("hmd_id", "dom").applyInPandas(run, "hmd_id int, dom long, kind int, a long, b long")
    done = scratch.table(done)
    kept = done.union(rows.join(some, ["hmd_id", "dom"], "left_anti")).where("kind > 0")
    gone = done.where("kind = 0").select("hmd_id", "dom", F.col("a").alias("place"), F.col("b").alias("v"))
    plain = scratch.table(across.union(kept.where("kind = 1").select("hmd_id", "a", "b")))
    return gone, scratch.table(at.join(gone.select("v"), "v", "left_anti").select("hmd_id", "v", "dom")), plain, scratch.table(kept.where("kind = 2").select("hmd_id", F.col("a").alias("e"), F.col("b").alias("v")))


def _domain_turns(vertices: DataFrame, plain: DataFrame, members: DataFrame, task_edges: int, scratch: Scratch) -> tuple[DataFrame | None, DataFrame, DataFrame, DataFrame]:
    """(gone(hmd_id, turn, dom, place, v), vertices, plain, members) after domains of growing size, or None for gone if none eliminated any."""
    gone, turn, at = None, 0, vertices.select("hmd_id", "v", F.col("v").alias("dom"))
    n = vertices.count()
    while (rows := plain.count() + members.count()) > min(task_edges, LEFT):
        most = max(2.0, min(DOMAIN, n * task_edges / (2 * rows)))
        nodes, edges = at.select("hmd_id", "v", F.lit(1).cast("long").alias("w")), plain.withColumn("w", F.lit(1).cast("long"))
        if turn:
            nodes = scratch.table(at.groupBy("hmd_id", F.col("dom").alias("v")).agg(F.count("*").alias("w")))
            ends = at.select(F.col("v").alias("u"), F.col("dom").alias("a")), at.select("v", F.col("dom").alias("b"))
            between = plain.join(ends[0], "u").join(ends[1], "v").where("a <> b")
            edges = scratch.table(between.groupBy("hmd_id", F.col("a").alias("u"), F.col("b").alias("v")).agg(F.count("*").alias("w")))
            most = min(most, MERGED * n / max(1, nodes.count()))
        to = domains(nodes, edges, most, scratch).select(F.col("v").alias("dom"), "to")
        at = at.join(to, "dom").select("hmd_id", "v", F.col("to").alias("dom"))
        step, at, plain, members = by_domains(scratch.table(at), plain, members, task_edges, scratch)
        step = step.withColumn("turn", F.lit(turn))
        gone = step if gone is None else gone.unionByName(step)
        before, n, turn = n, at.count(), turn + 1
        if n > 0.8 * before:
            break
    return gone, at.select("hmd_id", "v"), plain, members


def _placed(gone: DataFrame) -> DataFrame:
    """hmd_id, v, label from gone(hmd_id, turn, dom, place, v): by turn, then domain; domains are counted first, so that no window holds vertices."""
    counts = gone.groupBy("hmd_id", "turn", "dom").agg(F.count("*").alias("n"))
    before = Window.partitionBy("hmd_id").orderBy("turn", "dom").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("hmd_id", "turn", "dom", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return gone.join(base, ["hmd_id", "turn", "dom"]).select("hmd_id", "v", (F.col("base") + F.col("place")).alias("label"))


def _after(first: DataFrame | None, then: DataFrame) -> DataFrame:
    """Labels of both, those of `then` after the others of its region."""
    if first is None:
        return then
    counts = F.broadcast(first.groupBy("hmd_id").agg(F.count("*").alias("n")))  # tree nodes
    return first.union(then.join(counts, "hmd_id", "left").select("hmd_id", "v", (F.col("label") + F.coalesce("n", F.lit(0))).alias("label")))


def _labels(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """hmd_id, v, label from (hmd_id, v, turn): by turn, then id; ranges of ids are counted first, so that no window holds a turn."""
    rows = turns.withColumn("part", F.expr("v div 65536"))
    counts = scratch.table(rows.groupBy("hmd_id", "turn", "part").agg(F.count("*").alias("n")))
    by_part = Window.partitionBy("hmd_id", "turn").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_turn = Window.partitionBy("hmd_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("hmd_id", "turn").agg(F.sum("n").alias("n")).select("hmd_id", "turn", F.coalesce(F.sum("n").over(by_turn), F.lit(0)).alias("base"))
    base = counts.select("hmd_id", "turn", "part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before")).join(totals, ["hmd_id", "turn"])
    own = F.row_number().over(Window.partitionBy("hmd_id", "turn", "part").orderBy("v")) - 1
    return rows.withColumn("own", own).join(base, ["hmd_id", "turn", "part"]).select("hmd_id", "v", (F.col("base") + F.col("before") + F.col("own")).alias("label"))


def minimum_degree_labels(regions: DataFrame, inside: DataFrame, task_edges: int) -> DataFrame:
    """hmd_id, v, label: an elimination order of each region by minimum degree; regions(hmd_id, v), inside(hmd_id, u, v)."""
    with Scratch(regions.sparkSession) as scratch:
        vertices = scratch.table(regions.select("hmd_id", F.col("v").cast("long").alias("v")))
        plain = scratch.table(inside.select("hmd_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
        members = scratch.table(plain.select("hmd_id", F.col("u").alias("e"), "v").limit(0))
        done, turn, finished, open_regions, early = None, 0, None, None, None
        while True:
            sizes = plain.groupBy("hmd_id").agg(F.count("*").alias("n")).union(members.groupBy("hmd_id").agg(F.count("*").alias("n")))
            large = {r["hmd_id"] for r in sizes.groupBy("hmd_id").agg(F.sum("n").alias("n")).where(F.col("n") > task_edges).select("hmd_id").collect()}  # tree nodes
            if large != open_regions:
                # regions that fit into a task leave as they are
                kept = F.col("hmd_id").isin(list(large))
                ready = scratch.table(_rest(*(x.where(~kept) for x in (vertices, plain, members))))
                finished = ready if finished is None else finished.union(ready)
                vertices, plain, members = (scratch.table(x.where(kept)) for x in (vertices, plain, members))
                begun, open_regions = open_regions is None, large
                if large and begun:
                    gone, vertices, plain, members = _domain_turns(vertices, plain, members, task_edges, scratch)
                    early = None if gone is None else scratch.table(_placed(gone))
                    continue
            if not large:
                break
            rated = scratch.table(degrees(vertices, plain, members))
            chosen = scratch.table(independent(rated, plain, members, turn))
            plain, members = eliminated(chosen, plain, members, scratch)
            left = vertices.join(chosen, ["hmd_id", "v"], "left_anti")
            also = scratch.table(interior(left, plain, members))
            members = members.join(also.select("v"), "v", "left_anti").select("hmd_id", "e", "v")
            vertices = scratch.table(left.join(also, ["hmd_id", "v"], "left_anti"))
            step = chosen.withColumn("turn", F.lit(2 * turn)).unionByName(also.withColumn("turn", F.lit(2 * turn + 1)))
            done = step if done is None else done.union(step)
            turn += 1
        if done is not None:
            early = scratch.table(_after(early, _labels(done, scratch)))
        return cut(_after(early, finished))
