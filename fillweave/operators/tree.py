"""Arithmetic of the separator tree, as column expressions.

Nodes are numbered like a heap: node i has the children 2i+1 and 2i+2. Nothing is stored for
the tree's edges; levels, ancestors, lowest common ancestors and post-order positions are bit
operations on the numbers.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

MAX_LEVELS = 12


def _int(x: Column | str | int) -> Column:
    return F.lit(x).cast("int") if isinstance(x, int) else (F.col(x) if isinstance(x, str) else x).cast("int")


def level(node: Column | str | int) -> Column:
    """The depth of a node; the root's is 0."""
    return (F.length(F.bin((_int(node) + 1).cast("long"))) - 1).cast("int")


def among(node: str, nodes: Iterable[int]) -> Column:
    """Whether a node is one of a few that are known, so that no join with a table of them is needed."""
    some = ", ".join(str(k) for k in nodes)
    return F.expr(f"{node} in ({some})") if some else F.lit(False)


def parent(node: Column | str) -> Column:
    return F.when(_int(node) > 0, F.shiftright(_int(node) - 1, 1)).otherwise(F.lit(-1)).cast("int")


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by.cast("int"))


def ancestor_at(node: Column | str, depth: Column) -> Column:
    """The ancestor of a node at a depth that isn't below it (the node is its own ancestor)."""
    return (_shift(_int(node) + 1, level(node) - depth) - 1).cast("int")


def is_separator(above: Column | str, below: Column | str) -> Column:
    """Whether the first node is a proper ancestor of the second; the root counts as its own."""
    a, b = _int(above), _int(below)
    proper = (a < b) & (level(a) < level(b)) & (ancestor_at(b, F.least(level(a), level(b))) == a)
    return proper | ((a == 0) & (b == 0))


def is_ancestor(above: Column | str, below: Column | str) -> Column:
    """Whether the first node is a proper ancestor of the second."""
    return is_separator(above, below) & (_int(above) != _int(below))


def common_ancestor(a: Column | str, b: Column | str) -> Column:
    """The lowest common ancestor; a node counts as its own ancestor."""
    a, b = _int(a), _int(b)
    top = F.least(level(a), level(b))
    x, y = _shift(a + 1, level(a) - top), _shift(b + 1, level(b) - top)
    up = F.when(x == y, F.lit(0)).otherwise(F.length(F.bin(x.bitwiseXOR(y).cast("long"))))
    return (_shift(x, up) - 1).cast("int")


def postorder(node: Column | str, levels: int) -> Column:
    """The node's position in the post-order of the full tree with `levels` levels below the root."""
    i = _int(node)
    start = F.lit(0)
    for d in range(1, levels + 1):
        right = _shift(i + 1, F.greatest(level(i) - d, F.lit(0))).bitwiseAND(F.lit(1)) == 1
        start = start + F.when((level(i) >= d) & right, F.lit(2 ** (levels - d + 1) - 1)).otherwise(F.lit(0))
    size = F.call_function("shiftleft", F.lit(1), (F.lit(levels + 1) - level(i)).cast("int"))
    return (start + size - 2).cast("int")


def first_of_level(depth: int) -> int:
    """The number of the first node at a depth."""
    return 2**depth - 1


def with_offsets(sizes: DataFrame, levels: int) -> DataFrame:
    """hmd_id, size and node_offset: vertices of all nodes before it in post-order.

    The tree has at most 2**(MAX_LEVELS + 1) nodes, so one window holds them all.
    """
    order = Window.orderBy("post").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select("hmd_id", "size", postorder("hmd_id", levels).alias("post"))
    return placed.select("hmd_id", "size", F.coalesce(F.sum("size").over(order), F.lit(0)).cast("long").alias("node_offset"))


def subtree_sizes(sizes: DataFrame, levels: int) -> DataFrame:
    """hmd_id, subtree_size and subtree_offset of each node that has vertices below or in it.

    Each node's row goes to all its ancestors, which are at most levels + 1.
    """
    placed = with_offsets(sizes, levels)
    up = placed.select(F.explode(F.sequence(F.lit(0), level("hmd_id"))).alias("depth"), "*")
    return up.groupBy(ancestor_at("hmd_id", F.col("depth")).alias("hmd_id")).agg(F.sum("size").alias("subtree_size"), F.min("node_offset").alias("subtree_offset"))


def topmost(nodes: DataFrame) -> DataFrame:
    """Those nodes of which no other is a proper ancestor."""
    up = nodes.select("hmd_id", F.explode(F.sequence(F.lit(0), level("hmd_id"))).alias("depth")).where(F.col("depth") < level("hmd_id"))
    up = up.select("hmd_id", ancestor_at("hmd_id", F.col("depth")).alias("above"))
    covered = up.join(nodes.select(F.col("hmd_id").alias("above")).distinct(), "above", "left_semi").select("hmd_id").distinct()
    return nodes.join(covered, "hmd_id", "left_anti")


def below(nodes: DataFrame, tops: DataFrame, proper: bool = True) -> DataFrame:
    """Rows of nodes that lie under (or, unless proper, are) one of the nodes in tops."""
    up = nodes.select("hmd_id").distinct().select("hmd_id", F.explode(F.sequence(F.lit(0), level("hmd_id"))).alias("depth"))
    if proper:
        up = up.where(F.col("depth") < level("hmd_id"))
    up = up.select("hmd_id", ancestor_at("hmd_id", F.col("depth")).alias("above"))
    hit = up.join(tops.select(F.col("hmd_id").alias("above")).distinct(), "above", "left_semi").select("hmd_id").distinct()
    return nodes.join(F.broadcast(hit), "hmd_id", "left_semi")  # tree nodes
