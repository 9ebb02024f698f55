"""Graphs and snapshots that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import matrix as X
from ..operators import mesh as M
from .lineage import large

WIDTH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return large(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def grid_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells of a grid, 50 to a row."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("v")).select("v", (F.col("v") % WIDTH).alias("x"), F.expr(f"cast(v div {WIDTH} as int)").alias("y"))


def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = grid_nodes(spark, sf_dir)
    right = nodes.where(F.col("x") < WIDTH - 1).select(F.col("v").alias("u"), (F.col("v") + 1).alias("v"))
    down = nodes.select(F.col("v").alias("u"), (F.col("v") + WIDTH).alias("v"))
    pairs = right.union(down).join(nodes.select("v"), "v", "left_semi").select("u", "v")
    return large(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))))


def grid_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 7-node tree over the grid by geometry: the middle column, then the middle row."""
    nodes = grid_nodes(spark, sf_dir)
    middle = F.broadcast(nodes.agg(F.expr("cast((max(y) + 1) div 2 as int)").alias("m")))  # one row
    s = F.when(F.col("x") < 25, 1).otherwise(2)
    at = F.when(F.col("x") == 25, 0).when(F.col("y") == F.col("m"), s).when(F.col("y") < F.col("m"), 2 * s + 1).otherwise(2 * s + 2)
    return large(nodes.crossJoin(middle).select("v", at.cast("int").alias("hmd_id")))


def extra_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u < v of edges between parts of one brand: two columns apart, or one row and one column."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("v"), F.col("p_brand").alias("brand"))
    steps = F.when(F.col("v") % WIDTH < WIDTH - 2, F.array(F.lit(2), F.lit(WIDTH + 1))).otherwise(F.array(F.lit(WIDTH + 1)))
    ends = part.where(F.col("v") % WIDTH < WIDTH - 1).select(F.col("v").alias("u"), "brand", F.explode(steps).alias("step"))
    pairs = ends.select("u", "brand", (F.col("u") + F.col("step")).alias("v"))
    return large(pairs.join(part, ["v", "brand"], "left_semi").select("u", "v"))


def snapshot_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large(M.with_edges(grid_edges(spark, sf_dir), extra_pairs(spark, sf_dir)))


def removed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the smallest size go."""
    return table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").cast("int").alias("v"))


def split_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the second size get a vertex beside them."""
    return table(spark, sf_dir, "part").where("p_size = 2").select(F.col("p_partkey").cast("int").alias("v"))


def grown(nodes: DataFrame, edges: DataFrame, dof_map: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, dof_map) with a vertex appended for each of the chosen (v, by old numbers)
    that has a higher neighbour, attached to it and to the lowest of those."""
    n = nodes.count()
    edges, nodes = large(edges), large(nodes)
    some = dof_map.join(chosen.select(F.col("v").alias("old_v")), "old_v", "left_semi").select(F.col("new_v").alias("u"))
    picks = edges.where("u < v").join(some, "u", "left_semi").groupBy("u").agg(F.min("v").alias("x"))
    new = M.relabelled(picks.withColumnRenamed("u", "v")).select((F.col("local_id") + n).cast("int").alias("w"), F.col("v").alias("u"), F.col("x").alias("v"))
    ends = new.select("w", F.explode(F.array("u", "v")).alias("x"))
    both = edges.select("u", "v").union(ends.select(F.col("w").alias("u"), F.col("x").alias("v"))).union(ends.select(F.col("x").alias("u"), F.col("w").alias("v")))
    return nodes.select("v").union(new.select("w")), both, dof_map.union(new.select("w", F.lit(-1)))


def lineitem_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by part and supplier as a sparse matrix."""
    lines = table(spark, sf_dir, "lineitem")
    entries = lines.select(F.col("l_partkey").cast("int").alias("row"), F.col("l_suppkey").cast("int").alias("col"), F.col("l_quantity").alias("val"))
    return X.summed(entries, X.task_parts(lines.count()))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths through each user's events in order of time, both directions."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select(F.lag("event_id").over(w).cast("int").alias("u"), F.col("event_id").cast("int").alias("v")).where("u is not null")
    return large(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))))


def weighted_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hmd_id, u, v, w of the first snapshot: grid edges weigh 1, the extra ones 2."""
    extra = extra_pairs(spark, sf_dir)
    both = extra.union(extra.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows = grid_edges(spark, sf_dir).withColumn("w", F.lit(1)).union(both.withColumn("w", F.lit(2)))
    return rows.groupBy(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).agg(F.max("w").cast("long").alias("w")).select(F.lit(0).alias("hmd_id"), "u", "v", "w")


def grid_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triangles for each cell of the grid that has a right and a lower neighbour."""
    nodes = grid_nodes(spark, sf_dir)
    corner = nodes.where(F.col("x") < WIDTH - 1).join(nodes.select((F.col("v") - WIDTH - 1).alias("v")), "v", "left_semi").select("v")
    v = F.col("v")
    upper = corner.select((2 * v).alias("f"), v.alias("a"), (v + 1).alias("b"), (v + WIDTH).alias("c"))
    return large(upper.union(corner.select((2 * v + 1).alias("f"), v + 1, v + WIDTH + 1, v + WIDTH)))


def edge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, op, ts, id: events as changes of edges between users and the number in their properties; errors remove, all others add."""
    events = table(spark, sf_dir, "events")
    other = F.get_json_object("props", "$.k").cast("long") + 10**9
    op = F.when(F.col("event_type") == "error", "remove").otherwise("add")
    return events.select(F.col("user_id").alias("u"), other.alias("v"), op.alias("op"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
