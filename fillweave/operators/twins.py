"""Compression before ordering: vertices of equal closed neighbourhoods are ordered as one.

Such vertices can stand next to each other in any order without more fill. They are found by
hashes of their neighbourhoods that don't depend on order, and told apart exactly afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import ordering as O
from .incremental import Settings


def twins(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """v, head: the smallest vertex with the same neighbours, both counted among them; a vertex without its like is its own head.

    Vertices whose hashes agree are compared with the smallest of them, neighbour by neighbour.
    Should hashes agree by chance, what differs from the smallest one stays alone.
    """
    closed = cut(edges.select("u", "v").union(vertices.select(F.col("v").alias("u"), "v")).distinct())
    prints = closed.groupBy("u").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("v", F.lit(k))).alias(f"h{k}") for k in (1, 2)))
    heads = prints.groupBy("n", "h1", "h2").agg(F.min("u").alias("head"), F.count("*").alias("like")).where("like > 1")
    likely = cut(prints.join(heads, ["n", "h1", "h2"]).where("u <> head").select("u", "head", "n"))
    mine = likely.join(closed, "u").select("u", "head", "n", "v")
    shared = mine.join(closed.select(F.col("u").alias("head"), "v"), ["head", "v"]).groupBy("u", "head", "n").agg(F.count("*").alias("both"))
    same = shared.where("both = n").select(F.col("u").alias("v"), "head")
    return vertices.select("v").join(same, "v", "left").select("v", F.coalesce("head", "v").alias("head"))


def contracted(groups: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the graph of heads."""
    a, b = groups.select(F.col("v").alias("u"), F.col("head").alias("a")), groups.select("v", F.col("head").alias("b"))
    near = edges.join(a, "u").join(b, "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    return groups.select(F.col("head").alias("v")).distinct(), near


def expanded(permutation: DataFrame, groups: DataFrame) -> DataFrame:
    """new_pos, v of all vertices: each head's place in its order goes to its group, in ascending order.

    Sizes of groups are summed by ranges of 65536 places first, so that no window holds all heads.
    """
    sized = groups.groupBy("head").agg(F.count("*").alias("size")).join(permutation.select(F.col("v").alias("head"), "new_pos"), "head")
    sized = cut(sized.withColumn("range", F.expr("new_pos div 65536")))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sized.groupBy("range").agg(F.sum("size").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.sum("size").over(Window.partitionBy("range").orderBy("new_pos")) - F.col("size")
    starts = sized.withColumn("own", own).join(base, "range").select("head", (F.col("base") + F.col("own")).alias("start"))
    place = F.row_number().over(Window.partitionBy("head").orderBy("v")) - 1
    return groups.withColumn("place", place).join(starts, "head").select((F.col("start") + F.col("place")).cast("int").alias("new_pos"), "v")


def compressed_order(vertices: DataFrame, edges: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(permutation, groups): the cold order of the graph of heads, expanded."""
    groups = cut(twins(vertices, edges))
    heads, near = (cut(x) for x in contracted(groups, edges))
    return expanded(O.cold(heads, near, settings).permutation, groups), groups
