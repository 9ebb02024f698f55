"""The ordering engine: cold orders, warm orders that reuse what a change left valid.

A state is four tables and never changes; each call returns the next one.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import decompose as D
from . import incremental as I
from . import matrix as X
from . import tree as T
from .incremental import Settings


@dataclass
class State:
    """dof(hmd_id, v, label), nodes (hmd_node rows), and the snapshot that they were made for."""

    dof: DataFrame
    nodes: DataFrame
    vertices: DataFrame
    edges: DataFrame


@dataclass
class Ordering:
    """permutation(new_pos, v), the next state, and how much of the last one was reused."""

    permutation: DataFrame
    state: State
    reuse: float
    changes: int
    rebuilt: bool
    reused_nodes: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)

    def expanded(self, dim: int) -> DataFrame:
        return X.expanded(self.permutation, dim)


def _finish(dof: DataFrame, vertices: DataFrame, edges: DataFrame, settings: Settings) -> State:
    dof = cut(dof.select("hmd_id", "v", "label"))
    return State(dof, cut(D.tree_nodes(dof, settings.depth())), vertices, edges)


def cold(vertices: DataFrame, edges: DataFrame, settings: Settings = Settings()) -> Ordering:
    """Order a graph from nothing."""
    clock = {}
    t = time.perf_counter()
    regions = D.decompose(vertices.select("v", F.lit(0).alias("hmd_id")), edges, settings.depth())
    clock["decompose"] = time.perf_counter() - t
    t = time.perf_counter()
    state = _finish(D.local_orders(regions, edges, settings.method, depth=settings.depth()), vertices, edges, settings)
    clock["order"] = time.perf_counter() - t
    none = state.nodes.select("hmd_id", F.lit(False).alias("reused"))
    return Ordering(D.assembled(state.dof, state.nodes), state, 0.0, 0, True, none, clock)


def _mapped(state: State, dof_map: DataFrame, edges: DataFrame, settings: Settings) -> DataFrame:
    """dof of the new numbering: survivors keep their regions, added vertices are placed ring by ring.

    What no ring reaches goes to the last node that has vertices (the root, if none has).
    """
    dof = cut(I.survivors(state.dof, dof_map))
    placed = cut(dof.select("v", "hmd_id"))
    waiting = cut(I.added(dof_map))
    new = None
    while not waiting.isEmpty():
        ring = cut(I.placement_ring(waiting, edges, placed))
        if ring.isEmpty():
            last = placed.agg(F.max("hmd_id")).first()[0] or 0
            ring = cut(waiting.select("v", F.lit(last).cast("int").alias("hmd_id")))
        placed = cut(placed.union(ring))
        waiting = cut(waiting.join(ring, "v", "left_anti"))
        new = ring if new is None else new.union(ring)
    if new is None:
        return dof
    return cut(I.compacted(dof.union(new.select("hmd_id", "v", F.lit(None).cast("int").alias("label")))))


def warm(state: State, vertices: DataFrame, edges: DataFrame, settings: Settings = Settings(), dof_map: DataFrame | None = None) -> Ordering:
    """Order the next snapshot, changing only what its differences make invalid.

    dof_map(new_v, old_v), old_v -1 for added vertices, says how the numbering changed; without
    one the vertices must be the same, else all is done anew.
    """
    clock = {}
    t = time.perf_counter()
    if dof_map is None:
        if vertices.join(state.vertices, "v", "full_outer").count() != state.vertices.count() or vertices.count() != state.vertices.count():
            return cold(vertices, edges, settings)
        dof, before = state.dof, state.edges
        extra = None
    else:
        if I.too_many_added(dof_map, settings):
            return cold(vertices, edges, settings)
        from .mesh import mapped_edges

        dof, before = _mapped(state, dof_map, edges, settings), cut(mapped_edges(state.edges, dof_map))
        extra = I.added(dof_map)
    clock["integrate"] = time.perf_counter() - t
    t = time.perf_counter()
    changed = I.changed_vertices(before, edges)
    if extra is not None:
        changed = changed.union(extra).distinct()
    regions = dof.select("v", "hmd_id")
    bad = cut(I.bad_edges(edges, changed, regions, settings.flag_within_region))
    clock["differences"] = time.perf_counter() - t
    t = time.perf_counter()
    changes = bad.count()
    relocated = None
    if changes and settings.aggressive:
        relocated = cut(I.relocations(bad, settings.relocate_level))
        regions = cut(I.moved(regions, relocated))
        labels = dof.select("v", "label").join(relocated.select("v", F.lit(True).alias("new")), "v", "left")
        dof = cut(I.compacted(regions.join(labels.select("v", F.when(F.col("new").isNull(), F.col("label")).alias("label")), "v")))
        bad = cut(bad.join(relocated.select(F.col("v").alias("u")), "u", "left_anti").join(relocated.select("v"), "v", "left_anti"))
    marks = I.filtered(I.dirty(bad))
    if relocated is not None:
        to = relocated.select("hmd_id", F.lit("fine").alias("kind")).distinct()
        marks = I.filtered(I.dirty(bad).union(to).distinct())
    if settings.lagging:
        tops = regions.select("hmd_id").distinct()
        inner = tops.select(T.parent("hmd_id").alias("hmd_id")).distinct()
        marks = I.lagged(marks, settings.lag_level, tops.join(inner, "hmd_id", "left_anti"))
    marks = cut(marks)
    touched = cut(I.dirty_vertices(marks, regions))
    n, d = regions.count(), touched.count()
    reuse = 1 - d / max(n, 1)
    if reuse < settings.least_reuse:
        again = cold(vertices, edges, settings)
        again.changes = changes
        return again
    if d:
        tops = touched.where("top is not null").select("v", F.col("top").alias("hmd_id"))
        again = D.decompose(tops, edges, settings.depth()).union(touched.where("top is null").select("v", "hmd_id"))
        orders = D.local_orders(again, edges, settings.method, depth=settings.depth())
        dof = dof.join(touched.select("v"), "v", "left_anti").select("hmd_id", "v", "label").union(orders)
    after = _finish(dof, vertices, edges, settings)
    clock["reorder"] = time.perf_counter() - t
    stale = touched.select("hmd_id").union(touched.where("top is not null").select("top")).distinct().withColumn("stale", F.lit(True))
    reused = after.nodes.join(stale, "hmd_id", "left").select("hmd_id", F.col("stale").isNull().alias("reused"))
    return Ordering(D.assembled(after.dof, after.nodes), after, reuse, changes, False, reused, clock)
