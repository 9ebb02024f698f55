"""Orders of a graph whose edges arrive as a stream.

Each micro-batch of edge changes makes the next snapshot; the engine mends the state, and the
permutation is written anew. The state stays in tables in a folder, one for each batch, so that
a batch that is run again starts from the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mesh as M
from ..operators import ordering as O
from ..operators.incremental import Settings
from . import settle

TABLES = ("dof", "nodes", "vertices", "edges", "permutation")


def save(ordering: O.Ordering, folder: str) -> None:
    s = ordering.state
    for name, df in zip(TABLES, (s.dof, s.nodes, s.vertices, s.edges, ordering.permutation), strict=True):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> tuple[O.State, DataFrame]:
    dof, nodes, vertices, edges, permutation = (spark.read.parquet(f"{folder}/{name}") for name in TABLES)
    return O.State(dof, nodes, vertices, edges), permutation


def applied(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges after changes(u, v, op), op `add` or `remove`; of several for one edge, removal wins."""
    pairs = lambda op: changes.where(F.col("op") == op).select("u", "v")
    gone = pairs("remove")
    gone = gone.union(gone.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return M.with_edges(edges, pairs("add")).join(gone.distinct(), ["u", "v"], "left_anti")


def on_batch(folder: str, settings: Settings = Settings()):
    """A foreachBatch function: states are in folder/<batch>, the first one in folder/start."""

    def run(changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        state, _ = load(spark, f"{folder}/{batch - 1}" if batch else f"{folder}/start")
        # edges at vertices that the graph hasn't got are dropped
        known = state.vertices.select("v")
        changes = changes.join(known, "v", "left_semi").join(known.select(F.col("v").alias("u")), "u", "left_semi")
        save(O.warm(state, state.vertices, applied(state.edges, changes), settings), f"{folder}/{batch}")

    return run


def maintain(changes: DataFrame, folder: str, checkpoint: str, settings: Settings = Settings()):
    """Start the stream of changes(u, v, op); available data is worked through and it ends.

    With columns ts and id, changes settle by their time, whatever batch they come in; without
    them a batch is taken as a whole, after all before it.
    """
    mode = "append"
    if {"ts", "id"} <= set(changes.columns):
        types, mode = dict(changes.dtypes), "update"
        changes = settle.latest(changes).select(*(F.col(c).cast(types[c]).alias(c) for c in ("u", "v")), "op")
    writer = changes.writeStream.outputMode(mode).foreachBatch(on_batch(folder, settings)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return settle.start(changes.sparkSession, writer)


def activity(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events and their values by type and window of time; works on streams and on tables."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
