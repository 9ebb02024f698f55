"""The last change of each edge, kept by key in a stream, so that late and repeated changes settle by their time.

changes(u, v, op, ts, id): op is `add` or `remove`, ts the time of the change, and id tells apart
changes of one time. A change counts if no later one of its edge, by (ts, id), has been seen, in
whatever batch or order they come.

`latest` keeps them by a streaming aggregate, for sinks that take updates; it is the way for many edges.
`settled` is for sinks that only append: it passes on but what makes an edge come or go, which takes
a Python call and three messages to the state store for each edge of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "u long, v long, op string, ts timestamp, id long"
STATE = "last"
#: Stands for no time and no id, so that these are older than any.
NONE = -(2**63)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastChange(StatefulProcessor):
    """Holds an edge's last change, and passes it on where it makes the edge come or go.

    A key's changes are read one by one, so that an edge with very many of them needs no more memory.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState(STATE, "op string, micros long, id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.last.get()
        best = tuple(held) if held is not None else None
        was = best[0] if best else None
        for row in rows:
            if best is None or (row.micros, row.id) > best[1:]:
                best = (row.op, row.micros, row.id)
        if held is None or best != tuple(held):
            self.last.update(best)
        if best[0] != was:
            yield Row(u=key[0], v=key[1], op=best[0], micros=best[1], id=best[2])

    def close(self) -> None:
        pass


def timed(changes: DataFrame) -> DataFrame:
    """u, v, op, micros, id with u < v; what has no time is older than all others, and what has no end or no known op is left out."""
    ends = changes.where("u is not null and v is not null and u <> v and op in ('add', 'remove')")
    micros = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NONE))
    return ends.select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"), "op", micros.alias("micros"), F.coalesce(F.col("id").cast("long"), F.lit(NONE)).alias("id"))


def _ts(micros: Column) -> Column:
    return F.when(micros > NONE, F.timestamp_micros(micros))


def _id(number: Column) -> Column:
    return F.when(number > NONE, number)


def settled(changes: DataFrame) -> DataFrame:
    """The stream of changes(u, v, op, ts, id) that make an edge come or go; at most one for each edge and batch.

    The first change of an edge is passed on even where it removes: it may be in the graph from
    before. The state has a row for each edge that ever changed, in RocksDB, parted by edge; removed
    edges stay in it, as a change from before the removal may still come. Queries of such streams
    are started by `start`, which sets the state store that they need.
    """
    out = "u long, v long, op string, micros long, id long"
    kept = timed(changes).groupBy("u", "v").transformWithState(LastChange(), out, "Append", "None")
    return kept.select("u", "v", "op", _ts(F.col("micros")).alias("ts"), _id(F.col("id")).alias("id"))


def latest(changes: DataFrame) -> DataFrame:
    """The stream of the last change so far of each edge that has one in a batch, for output mode `update`; at most one for each edge and batch.

    An edge may come again with the change that it had. Of changes of one time and id a removal counts. The state
    is that of an aggregate by edge, a row for each edge that ever changed; `start` starts its queries, too.
    """
    last = timed(changes).groupBy("u", "v").agg(F.max(F.struct("micros", "id", "op")).alias("last"))
    return last.select("u", "v", "last.op", _ts(F.col("last.micros")).alias("ts"), _id(F.col("last.id")).alias("id"))


def latest_edges(spark: SparkSession, checkpoint: str) -> DataFrame:
    """u, v, ts, id of the edges whose last change added them, from the state that a stream of `latest` left in its checkpoint folder."""
    rows = spark.read.format("statestore").option("path", checkpoint).load()
    last = rows.select("key.u", "key.v", F.col(f"value.{rows.schema['value'].dataType.names[0]}").alias("last"))
    return last.where("last.op = 'add'").select("u", "v", _ts(F.col("last.micros")).alias("ts"), _id(F.col("last.id")).alias("id"))


def start(spark: SparkSession, writer):
    """Start a stream that keeps state by key: only this query gets the state store that such states need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def edges_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """u, v, ts, id of the edges whose last change added them, read from the state that a stream of `settled` left in its checkpoint folder."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", STATE).load()
    alive = rows.where("value.op = 'add'").select("key.u", "key.v", "value.micros", "value.id")
    return alive.select("u", "v", _ts(F.col("micros")).alias("ts"), _id(F.col("id")).alias("id"))
