"""Other files: dense CSV, vectors, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a run log, one row for each solve (fixed values).
RUN_COLUMNS = [
    ("n", "long"), ("nnz", "long"), ("l_nnz", "long"), ("nthreads", "int"), ("frame_num", "int"), ("newton_iter", "int"), ("residual", "double"),
    ("load_time", "double"), ("analyze_time", "double"), ("ordering_time", "double"), ("factor_time", "double"), ("solve_time", "double"),
    ("contact_size", "long"), ("reuse", "double"), ("baseline_reuse", "double"), ("max_possible_reuse", "double"), ("integration_time", "double"),
    ("change_detection_time", "double"), ("permutation_time", "double"), ("map_time", "double"), ("ordering_total_time", "double"), ("reordering", "string"),
    ("total_load_time", "double"), ("total_analyze_time", "double"), ("total_factor_time", "double"), ("total_solve_time", "double"), ("end_to_end_time", "double"),
]
RUN_SCHEMA = ", ".join(f"{n} {t}" for n, t in RUN_COLUMNS)


def read_dense(spark: SparkSession, path: str, columns: int, kind: str = "double") -> DataFrame:
    """A headerless CSV of numbers as columns c0, c1, ..."""
    return spark.read.schema(", ".join(f"c{i} {kind}" for i in range(columns))).csv(path)


def write_dense(df: DataFrame, path: str) -> None:
    df.write.csv(path)


def write_vector(values: DataFrame, path: str) -> None:
    """values(idx, val): one value for each line, in order of idx."""
    values.repartitionByRange("idx").sortWithinPartitions("idx").select(F.col("val").cast("string").alias("value")).write.text(path)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").cast("double").alias("val"))


def append_runs(spark: SparkSession, records: list[dict], path: str) -> None:
    """Append records to a run log; columns that the log hasn't got, or missing ones, are errors."""
    known = {n for n, _ in RUN_COLUMNS}
    for r in records:
        if set(r) != known:
            raise ValueError(f"unknown {sorted(set(r) - known)}, missing {sorted(known - set(r))}")
    schema = T._parse_datatype_string(RUN_SCHEMA)
    spark.createDataFrame([tuple(r[n] for n, _ in RUN_COLUMNS) for r in records], schema).write.mode("append").option("header", True).csv(path)


def run_record(ordering, n: int, nnz: int, method: str, frame: int = 0, iteration: int = 0, **known) -> dict:
    """A row of the run log for one ordering; what isn't known of it is null. Other columns by name."""
    t = ordering.seconds
    own = {
        "n": n, "nnz": nnz, "frame_num": frame, "newton_iter": iteration, "contact_size": ordering.changes, "reuse": float(ordering.reuse), "reordering": method,
        "integration_time": t.get("integrate", 0.0), "change_detection_time": t.get("differences", 0.0),
        "permutation_time": t.get("decompose", 0.0) + t.get("order", 0.0) + t.get("reorder", 0.0), "ordering_time": sum(t.values()), "ordering_total_time": sum(t.values()),
    }
    return {name: None for name, _ in RUN_COLUMNS} | own | known


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).option("header", True).csv(path)


def median_seconds(runs: DataFrame, by: str, column: str) -> DataFrame:
    return runs.groupBy(by).agg(F.percentile(column, 0.5).alias("median"))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path, size and time of a folder's files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")


def split_literal(column, separator: str):
    """Split at a literal separator, empty pieces kept."""
    return F.split(column, "\\Q" + separator + "\\E", -1)
