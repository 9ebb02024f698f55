"""What a new snapshot of a graph makes invalid in a decomposition, and how to mend just that."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.lineage import cut
from . import mesh as M
from . import tree as T


@dataclass(frozen=True)
class Settings:
    """levels: depth of the tree; lag_level, relocate_level: bounds of the two approximations."""

    levels: int = 8
    method: str = "nested"
    lagging: bool = True
    lag_level: int = 5
    aggressive: bool = False
    relocate_level: int = 2
    flag_within_region: bool = False
    least_reuse: float = 0.2
    most_added: float = 0.4

    def depth(self) -> int:
        """Trees deeper than 12 levels are made with 10."""
        return 10 if self.levels > T.MAX_LEVELS else self.levels


def is_bad(ru: Column, rv: Column) -> Column:
    """Whether an edge's ends are in regions that mustn't touch."""
    return (ru != rv) & ~T.is_separator(F.least(ru, rv), F.greatest(ru, rv))


def inverted(dof_map: DataFrame) -> DataFrame:
    """old_v, new_v of the vertices that both snapshots have; dof_map(new_v, old_v), -1 for added."""
    return dof_map.where("old_v <> -1").select("old_v", "new_v")


def added(dof_map: DataFrame) -> DataFrame:
    return dof_map.where("old_v = -1").select(F.col("new_v").alias("v"))


def removed(dof_map: DataFrame, old_nodes: DataFrame) -> DataFrame:
    return old_nodes.join(inverted(dof_map).select(F.col("old_v").alias("v")), "v", "left_anti")


def too_many_added(dof_map: DataFrame, settings: Settings) -> bool:
    r = dof_map.agg(F.count_if(F.col("old_v") == -1).alias("a"), F.count("*").alias("n")).first()
    return r["a"] > settings.most_added * r["n"]


def changed_vertices(before: DataFrame, after: DataFrame) -> DataFrame:
    """Vertices whose neighbours differ between two snapshots of one numbering."""
    return M.changed_edges(before, after).select(F.col("u").alias("v")).distinct()


def bad_edges(after: DataFrame, changed: DataFrame, regions: DataFrame, within_region: bool = False) -> DataFrame:
    """u < v of the changed vertices' present edges that cross regions that mustn't touch.

    Removed edges so never make anything invalid. With within_region, edges inside one region
    count too. Regions ru, rv come along.
    """
    near = after.join(changed.select(F.col("v").alias("u")), "u", "left_semi")
    pairs = near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    both = M.edge_regions(pairs, regions)
    bad = is_bad(F.col("ru"), F.col("rv"))
    return both.where(bad | (F.col("ru") == F.col("rv")) if within_region else bad)


def dirty(bad: DataFrame) -> DataFrame:
    """hmd_id, kind: regions to order again (fine) and subtrees to split again (coarse)."""
    fine = bad.where("ru = rv").select(F.col("ru").alias("hmd_id"), F.lit("fine").alias("kind"))
    apart = bad.where(is_bad(F.col("ru"), F.col("rv")))
    coarse = apart.select(T.common_ancestor("ru", "rv").alias("hmd_id"), F.lit("coarse").alias("kind"))
    return fine.union(coarse).distinct()


def filtered(marks: DataFrame) -> DataFrame:
    """Without what a coarse node above (or, for a fine one, the same node) covers already."""
    marks = cut(marks)  # a row for each tree node at most
    coarse = T.topmost(marks.where("kind = 'coarse'"))
    fine = marks.where("kind = 'fine'")
    covered = T.below(fine, coarse, proper=False).select("hmd_id")
    return coarse.union(fine.join(covered, "hmd_id", "left_anti"))


def lagged(marks: DataFrame, lag_level: int = 5, leaves: DataFrame | None = None) -> DataFrame:
    """Drop fine leaves, and coarse nodes too deep to matter.

    The bound is one less than the first node of level lag_level + 1, which so leaves out the
    last node of level lag_level.
    """
    bound = T.first_of_level(lag_level + 1) - 1
    coarse = marks.where((F.col("kind") == "coarse") & (F.col("hmd_id") < bound))
    fine = marks.where("kind = 'fine'")
    if leaves is not None:
        fine = fine.join(leaves.select("hmd_id"), "hmd_id", "left_anti")
    return coarse.union(fine)


def dirty_vertices(marks: DataFrame, regions: DataFrame) -> DataFrame:
    """v, hmd_id, and for coarse ones the top of the subtree. Marks and tops are of tree nodes, so they are broadcast."""
    fine = regions.join(F.broadcast(marks.where("kind = 'fine'").select("hmd_id")), "hmd_id", "left_semi").select("v", "hmd_id", F.lit(None).cast("int").alias("top"))
    up = regions.select("hmd_id").distinct().select("hmd_id", F.explode(F.sequence(F.lit(0), T.level("hmd_id"))).alias("d"))
    up = up.select("hmd_id", T.ancestor_at("hmd_id", F.col("d")).alias("top"))
    tops = up.join(marks.where("kind = 'coarse'").select(F.col("hmd_id").alias("top")), "top")
    return fine.union(regions.join(F.broadcast(tops), "hmd_id").select("v", "hmd_id", "top")).dropDuplicates(["v"])


def reuse_ratio(marks: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: vertices, those that are dirty, and the share that isn't."""
    bad = dirty_vertices(marks, regions).agg(F.count("*").alias("dirty"))
    return regions.agg(F.count("*").alias("vertices")).crossJoin(bad).select("vertices", "dirty", (1 - F.col("dirty") / F.greatest("vertices", F.lit(1))).alias("reuse"))


def relocations(bad: DataFrame, relocate_level: int = 2) -> DataFrame:
    """v and the region it moves to: for bad edges whose common ancestor is near the root, the end
    that occurs in more of them (of equals the second) goes to the smallest such ancestor."""
    ends = bad.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    both = bad.join(ends.select(F.col("x").alias("u"), F.col("n").alias("nu")), "u").join(ends.select(F.col("x").alias("v"), F.col("n").alias("nv")), "v")
    near = both.select(F.when(F.col("nu") > F.col("nv"), F.col("u")).otherwise(F.col("v")).alias("v"), T.common_ancestor("ru", "rv").alias("to"))
    return near.where(F.col("to") < T.first_of_level(relocate_level + 1)).groupBy("v").agg(F.min("to").alias("hmd_id"))


def moved(regions: DataFrame, moves: DataFrame) -> DataFrame:
    to = moves.select("v", F.col("hmd_id").alias("to"))
    return regions.join(to, "v", "left").select("v", F.coalesce("to", "hmd_id").alias("hmd_id"))


def compacted(dof: DataFrame) -> DataFrame:
    """dof(hmd_id, v, label) with labels renumbered from 0 in each region, in their order."""
    w = Window.partitionBy("hmd_id").orderBy(F.col("label").asc_nulls_last(), "v")
    return dof.select("hmd_id", "v", (F.row_number().over(w) - 1).cast("int").alias("label"))


def survivors(dof: DataFrame, dof_map: DataFrame) -> DataFrame:
    """dof of the old numbering in the new one, without removed vertices, labels compacted."""
    kept = dof.join(inverted(dof_map).select(F.col("old_v").alias("v"), "new_v"), "v")
    return compacted(kept.select("hmd_id", F.col("new_v").alias("v"), "label"))


def placement_ring(waiting: DataFrame, edges: DataFrame, regions: DataFrame) -> DataFrame:
    """v, hmd_id of waiting vertices that have placed neighbours.

    With one neighbouring region they go there; with several, to the smallest over their pairs
    of: the lower of the two if one is above the other, else the common ancestor.
    """
    near = edges.join(waiting.select(F.col("v").alias("u")), "u", "left_semi").join(regions, "v").select(F.col("u").alias("v"), "hmd_id").distinct()
    a, b = near.withColumnRenamed("hmd_id", "a"), near.withColumnRenamed("hmd_id", "b")
    pairs = a.join(b, "v").where("a < b")
    meet = F.when(T.is_separator("a", "b"), F.col("b")).otherwise(T.common_ancestor("a", "b"))
    many = pairs.groupBy("v").agg(F.min(meet).alias("meet"))
    one = near.groupBy("v").agg(F.min("hmd_id").alias("only"))
    return one.join(many, "v", "left").select("v", F.coalesce("meet", "only").cast("int").alias("hmd_id"))
