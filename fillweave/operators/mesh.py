"""Graphs of matrices: `edges(u, v)` holds both directions, no loops, no repeats; `nodes(v)`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.lineage import cut, large


def mesh_from_matrix(coo: DataFrame, dim: int = 1) -> DataFrame:
    """The graph of a sparse matrix whose rows stand in blocks of dim: block-compress, symmetrise."""
    block = coo.select(F.expr(f"cast(col div {dim} as int)").alias("u"), F.expr(f"cast(row div {dim} as int)").alias("v")).where("u <> v")
    return block.union(block.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def check_blocks(coo: DataFrame, dim: int) -> DataFrame:
    """One row: entries, blocks, and whether each block that occurs is dense (dim * dim entries)."""
    entries = coo.select(F.expr(f"row div {dim}").alias("r"), F.expr(f"col div {dim}").alias("c"), "row", "col").distinct()
    blocks = entries.groupBy("r", "c").agg(F.count("*").alias("n"))
    return blocks.agg(F.sum("n").alias("entries"), F.count("*").alias("blocks"), F.coalesce(F.min("n") == dim * dim, F.lit(True)).alias("dense"))


def check_mesh(edges: DataFrame) -> DataFrame:
    """One row: loops, repeated edges and edges without their reverse."""
    once = large(edges).groupBy("u", "v").agg(F.count("*").alias("n"))
    back = once.select(F.col("v").alias("u"), F.col("u").alias("v"))
    facts = once.agg(F.sum(F.when(F.col("u") == F.col("v"), F.col("n")).otherwise(0)).alias("loops"), F.sum(F.col("n") - 1).alias("repeats"))
    return facts.crossJoin(once.join(back, ["u", "v"], "left_anti").agg(F.count("*").alias("one_way")))


def adjacency(edges: DataFrame) -> DataFrame:
    """u and its neighbours in ascending order."""
    return edges.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("neighbours"))


def row_pointers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """v, degree, and the exclusive running sum of degrees: where v's row begins.

    Totals of ranges of 65536 vertices are summed first, so that no window holds all vertices.
    """
    degree = edges.groupBy(F.col("u").alias("v")).agg(F.count("*").alias("degree"))
    rows = nodes.join(degree, "v", "left").select("v", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.expr("v div 65536").alias("part"))
    totals = rows.groupBy("part").agg(F.sum("degree").alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("own", F.coalesce(F.sum("degree").over(inner), F.lit(0))).join(totals, "part").select("v", "degree", (F.col("base") + F.col("own")).cast("long").alias("pointer"))


def submesh(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """The edges both of whose ends are chosen."""
    return edges.join(chosen.select(F.col("v").alias("u")), "u", "left_semi").join(chosen.select("v"), "v", "left_semi").select("u", "v")


def relabelled(chosen: DataFrame, by: str | None = None) -> DataFrame:
    """Local ids 0, 1, ... of chosen vertices in ascending order, within each value of `by`."""
    if by:
        return chosen.withColumn("local_id", (F.row_number().over(Window.partitionBy(by).orderBy("v")) - 1).cast("long"))
    spans = chosen.withColumn("part", F.expr("v div 65536"))
    counts = spans.groupBy("part").agg(F.count("*").alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = spans.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1)
    # a row for each range is broadcast
    return own.join(F.broadcast(base), "part").select(*chosen.columns, (F.col("base") + F.col("own")).cast("long").alias("local_id"))


def region_edges(edges: DataFrame, regions: DataFrame, chosen: list[int] | None = None) -> DataFrame:
    """hmd_id, u, v of the edges that lie in one region; in one of the chosen, if given."""
    at = regions.select("v", "hmd_id")
    if chosen is not None:
        at = at.where(F.col("hmd_id").isin(chosen))
    left = edges.join(at.withColumnsRenamed({"v": "u"}), "u")
    return left.join(at.withColumnRenamed("hmd_id", "other"), "v").where("hmd_id = other").select("hmd_id", "u", "v")


def edge_regions(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """u, v and the regions of both ends."""
    at = regions.select("v", "hmd_id")
    left = edges.join(at.withColumnsRenamed({"v": "u", "hmd_id": "ru"}), "u")
    return left.join(at.withColumnRenamed("hmd_id", "rv"), "v").select("u", "v", "ru", "rv")


def region_degrees(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """hmd_id and the sum of its vertices' degrees, edges that leave the region included."""
    degree = edges.groupBy(F.col("u").alias("v")).agg(F.count("*").alias("degree"))
    return regions.join(degree, "v", "left").groupBy("hmd_id").agg(F.coalesce(F.sum("degree"), F.lit(0)).cast("long").alias("total_edges"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    count = edges.groupBy(F.col("u").alias("v")).agg(F.count("*").alias("degree"))
    return nodes.join(count, "v", "left").select("v", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def top_degree(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The k vertices of highest degree, ties by id."""
    return degrees(nodes, edges).orderBy(F.desc("degree"), "v").limit(k)


def added_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.select("u", "v").exceptAll(before.select("u", "v"))


def changed_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """The symmetric difference of two snapshots with what happened to each edge."""
    gone = added_edges(after, before).withColumn("change", F.lit("removed"))
    return added_edges(before, after).withColumn("change", F.lit("added")).union(gone)


def with_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """The snapshot with more edges, which get both directions."""
    pairs = more.select("u", "v").where("u <> v")
    return edges.union(pairs).union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def without_vertices(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, dof_map) after removing vertices; survivors are numbered anew in order."""
    kept = relabelled(nodes.join(removed.select("v"), "v", "left_anti"))
    dof_map = cut(kept.select(F.col("local_id").cast("int").alias("new_v"), F.col("v").alias("old_v")))
    new = mapped_edges(edges, dof_map)
    return dof_map.select(F.col("new_v").alias("v")), new, dof_map


def mapped_edges(edges: DataFrame, dof_map: DataFrame) -> DataFrame:
    """Edges of the old numbering in the new one; those at removed vertices fall away."""
    a = dof_map.where("old_v >= 0").select(F.col("old_v").alias("u"), F.col("new_v").alias("nu"))
    b = dof_map.where("old_v >= 0").select(F.col("old_v").alias("v"), F.col("new_v").alias("nv"))
    return large(edges.join(large(a), "u").join(large(b), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v")))
