"""Cutting of lineage in iterative plans, by checkpoints in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one set, or on one machine a new one where none is set."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        said = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(said)
    return said


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def large(df: DataFrame) -> DataFrame:
    """The same rows, for joins by shuffles alone.

    Spark takes the size of a compressed file for that of its rows: a column of ids takes a tenth of its
    share there, so that tables of millions of rows go to the driver to be broadcast. What is
    surely small is broadcast by F.broadcast, which goes before this hint.
    """
    return df.hint("shuffle_merge")


class Scratch:
    """Tables that one run of an operator needs, in a folder of their own in the shared one, which goes when the run ends.

    A written table has the size that it has. A checkpoint keeps the size that was estimated from
    the plan before it; over many rounds of joins these estimates multiply into numbers so long
    that planning never ends.

        with Scratch(spark) as scratch:
            rows = scratch.table(rows)
            ...
            return cut(rows)
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.tables = spark, new_path(spark, "scratch"), 0

    def table(self, df: DataFrame) -> DataFrame:
        """The same rows, written and read again."""
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        df.write.parquet(path)
        return large(self.spark.read.schema(df.schema).parquet(path))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, checkpointed: in the cluster's spark.checkpoint.dir, or on one machine a new folder where none is set."""
    shared_dir(df.sparkSession)
    return large(df.checkpoint())
