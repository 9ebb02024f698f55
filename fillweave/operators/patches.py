"""Patches of triangle meshes by rings of faces, and chains of vertex maps.

faces(f, a, b, c) are triangles by vertex; a vertex map (new_v, old_v) has old_v -1 where a vertex
is new.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.lineage import Scratch, cut

#: Ids of faces whose rings one task finds.
RANGE = 1 << 20


def incidence(faces: DataFrame) -> DataFrame:
    """f, v of each face's corners, once each."""
    return faces.select("f", F.explode(F.array_distinct(F.array("a", "b", "c"))).alias("v"))


def _local_rings(corners: pd.DataFrame, starts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(faces, their rings, vertices, their rings) of one range of faces; what isn't reached has -1.

    starts are seeds (kind 0) and vertices whose ring is known from elsewhere (kind 1, ring).
    """
    faces, f = np.unique(corners["f"].to_numpy(), return_inverse=True)
    ids, v = np.unique(corners["v"].to_numpy(), return_inverse=True)
    vertices_of, faces_of = kernels.csr(len(faces), f, v), kernels.csr(len(ids), v, f)
    face_ring, ring_of = np.full(len(faces), -1), np.full(len(ids), -1)
    seed = starts["kind"].to_numpy() == 0
    front = np.searchsorted(faces, starts["id"].to_numpy()[seed])
    known = starts[~seed].sort_values("ring")
    known_at, known_ring = np.searchsorted(ids, known["id"].to_numpy()), known["ring"].to_numpy()
    face_ring[front], ring, k = 0, 0, 0
    while len(front) or k < len(known_at):
        if not len(front):
            ring = int(known_ring[k])
        near = kernels.gathered(*vertices_of, front)
        till = int(np.searchsorted(known_ring, ring, side="right"))
        near = np.unique(np.concatenate([near, known_at[k:till]]))
        near, k = near[ring_of[near] < 0], till
        ring_of[near] = ring
        front = np.unique(kernels.gathered(*faces_of, near))
        front = front[face_ring[front] < 0]
        ring += 1
        face_ring[front] = ring
    return faces, face_ring, ids, ring_of


def _last_ring(counts: DataFrame, wanted: float) -> int | None:
    """The first ring by which `wanted` faces are reached, from counts(ring, n); None if fewer are."""
    spans = sorted((r["span"], r["n"]) for r in counts.groupBy(F.expr("ring div 65536").alias("span")).agg(F.sum("n").alias("n")).collect())
    before = 0
    for span, n in spans:
        if before + n >= wanted:
            rings = counts.where(F.expr("ring div 65536") == span).groupBy("ring").agg(F.sum("n").alias("n"))
            total = rings.select("ring", (F.sum("n").over(Window.orderBy("ring")) + before).alias("total"))  # at most 65536 rows
            return total.where(F.col("total") >= wanted).agg(F.min("ring")).first()[0]
        before += n
    return None


def patch(faces: DataFrame, seeds: DataFrame, share: float, width: int = RANGE) -> DataFrame:
    """f, ring: the faces around seeds(f), ring by ring, until they are `share` of all faces or none is left to reach.

    Ring 0 are the seeds, each further ring the faces that share a vertex with the one before. The
    last ring is taken whole. Ranges of `width` face ids find their rings in a task each, and tell
    other ranges the rings of the vertices that they share; a range is searched again when such a
    ring has got smaller. What comes before the smallest of these is settled, so there are no more
    rounds than rings, and about as many as ranges in a row where near faces have near ids.
    """
    with Scratch(faces.sparkSession) as scratch:
        at = scratch.table(incidence(faces).distinct().select(F.col("f").cast("long").alias("f"), F.col("v").cast("long").alias("v"), F.expr(f"cast(f div {width} as long)").alias("at")))
        wanted = share * at.select("f").distinct().count()
        first = scratch.table(seeds.select(F.col("f").cast("long").alias("f")).distinct().join(at.select("f", "at").distinct(), "f"))
        lowest = first.select("at", F.lit(0).alias("kind"), F.col("f").alias("id"), F.lit(0).cast("long").alias("ring"))
        pairs = at.select("v", "at").distinct()
        shared = scratch.table(pairs.join(pairs.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v"), "v", "left_semi"))
        known = scratch.table(shared.select("v", F.lit(0).cast("long").alias("ring")).limit(0))

        def searched(run, schema: str, where: DataFrame | None) -> DataFrame:
            starts = lowest.union(shared.join(known, "v").select("at", F.lit(1), F.col("v"), "ring"))
            own = at
            if where is not None:
                own, starts = (x.join(F.broadcast(where), "at", "left_semi") for x in (own, starts))  # ranges
            return own.groupBy("at").cogroup(starts.groupBy("at")).applyInPandas(run, schema)

        def told(key, corners: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
            _, face_ring, ids, ring_of = _local_rings(corners, starts)
            rings, n = np.unique(face_ring[face_ring >= 0], return_counts=True)
            met = ring_of >= 0
            return pd.DataFrame({"at": key[0], "kind": np.repeat([0, 1], [met.sum(), len(rings)]), "id": np.concatenate([ids[met], rings]), "ring": np.concatenate([ring_of[met], n])})

        def reached(key, corners: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
            found, face_ring, _, _ = _local_rings(corners, starts)
            return pd.DataFrame({"f": found[face_ring >= 0], "ring": face_ring[face_ring >= 0]})

        active, counts, last = scratch.table(first.select("at").distinct()), None, None
        while not active.isEmpty():
            out = scratch.table(searched(told, "at long, kind int, id long, ring long", active))
            fresh = out.where("kind = 1").select("at", F.col("id").alias("ring"), F.col("ring").alias("n"))
            counts = scratch.table(fresh if counts is None else counts.join(F.broadcast(active), "at", "left_anti").union(fresh))
            seen = out.where("kind = 0").select(F.col("id").alias("v"), "ring", F.col("at").alias("by")).join(shared.select("v").distinct(), "v", "left_semi")
            best = seen.groupBy("v").agg(F.min(F.struct("ring", "by")).alias("b")).select("v", "b.ring", "b.by")
            better = scratch.table(best.join(known.withColumnRenamed("ring", "was"), "v", "left").where("was is null or ring < was").select("v", "ring", "by"))
            known = scratch.table(known.union(better.select("v", "ring")).groupBy("v").agg(F.min("ring").alias("ring")))
            settled = better.agg(F.min("ring")).first()[0]
            done = counts.select("ring", "n") if settled is None else counts.where(F.col("ring") <= settled).select("ring", "n")
            last = _last_ring(done, wanted)
            if last is not None:
                break
            active = scratch.table(shared.join(better, "v").where("at <> by").select("at").distinct())
        rings = searched(reached, "f long, ring long", None)
        kind = faces.schema["f"].dataType
        # without enough faces all that are reached count; seeds alone may be enough
        return cut((rings if last is None else rings.where(F.col("ring") <= last)).select(F.col("f").cast(kind).alias("f"), F.col("ring").cast("int").alias("ring")))


def composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """The map from the last numbering to the first one: first(new_v, old_v), then `then` on its new numbers.

    A vertex that either map adds is new (-1).
    """
    middle = first.select(F.col("new_v").alias("mid"), F.col("old_v").alias("far"))
    near = then.select("new_v", F.col("old_v").alias("mid"))
    return near.join(middle, "mid", "left").select("new_v", F.coalesce("far", F.lit(-1)).cast("int").alias("old_v"))


def composed_chain(maps: list[DataFrame]) -> DataFrame:
    """The map of a sequence of maps, the earliest first: neighbours are composed, then their results, so that a plan is log2 of their number deep."""
    if not maps:
        raise ValueError("no map to compose")
    while len(maps) > 1:
        maps = [cut(composed(*maps[i : i + 2])) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]
