"""Matrix Market files as tables: a Python data source for reading, Spark's text writer for writing."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.lineage import Scratch, cut

FIELDS = ("real", "integer", "complex", "pattern")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")
SCHEMA = "row int, col int, val double, imag double"


def parse_banner(line: str) -> dict[str, str]:
    """The kinds named in a file's first line; raises ValueError for what the format doesn't allow."""
    words = line.split()
    if len(words) != 5 or words[0] != "%%MatrixMarket" or words[1].lower() != "matrix":
        raise ValueError(f"not a Matrix Market banner: {line!r}")
    layout, kind, symmetry = (w.lower() for w in words[2:])
    if layout not in ("coordinate", "array") or kind not in FIELDS or symmetry not in SYMMETRIES:
        raise ValueError(f"unknown kind of matrix: {line!r}")
    bad = (layout == "array" and kind == "pattern") or (kind == "real" and symmetry == "hermitian") or (kind == "pattern" and symmetry in ("hermitian", "skew-symmetric"))
    if bad:
        raise ValueError(f"kinds that don't go together: {line!r}")
    return {"layout": layout, "field": kind, "symmetry": symmetry}


def banner(layout: str, kind: str, symmetry: str) -> str:
    line = f"%%MatrixMarket matrix {layout} {kind} {symmetry}"
    parse_banner(line)
    return line


class MatrixMarketSource(DataSource):
    """spark.read.format("mtx").load(path): row, col (from 0), val, imag as in the file.

    The triangle of a symmetric file is given as it stands; mirrored() fills in the other.
    """

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


@dataclass
class _Range(InputPartition):
    """Bytes of a file: the lines that begin in them."""

    begin: int
    end: int


class _Reader(DataSourceReader):
    """Options: path (local, or of a store that pyarrow opens), split_bytes (of a partition).

    A coordinate file is read by ranges of bytes, each partition's lines being those that begin in
    its range; only the header is read to plan them. Values of the array layout have no places of
    their own, so such a file is one partition here; read_array() reads them in parallel.
    """

    def __init__(self, options) -> None:
        self.path, self.split_bytes = options["path"], int(options.get("split_bytes", 64 << 20))

    def _open(self) -> io.BufferedReader:
        if "://" in self.path:
            store, path = fs.FileSystem.from_uri(self.path)
        else:
            store, path = fs.LocalFileSystem(), self.path
        return io.BufferedReader(store.open_input_file(path), 1 << 20)

    @staticmethod
    def _header(lines: io.BufferedReader) -> tuple[dict[str, str], list[int], int]:
        """The kinds, the sizes, and where the body begins."""
        kinds = parse_banner(lines.readline().decode("ascii"))
        for line in lines:
            if line.strip() and not line.startswith(b"%"):
                return kinds, [int(x) for x in line.split()], lines.tell()
        raise ValueError("no size line")

    def partitions(self) -> list[_Range]:
        with self._open() as lines:
            kinds, _, begin = self._header(lines)
            end = lines.seek(0, io.SEEK_END)
        step = self.split_bytes if kinds["layout"] == "coordinate" else max(1, end - begin)
        return [_Range(x, min(x + step, end)) for x in range(begin, max(end, begin + 1), step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with self._open() as lines:
            kinds, size, begin = self._header(lines)
            if kinds["layout"] == "array":
                yield from _array((x.split() for x in lines if x.strip() and not x.startswith(b"%")), size[0], size[1], kinds)
                return
            at = partition.begin
            if at > begin:
                lines.seek(at - 1)
                at += len(lines.readline()) - 1  # the rest of a line that began before
            else:
                lines.seek(at)
            while at < partition.end and (line := lines.readline()):
                at += len(line)
                x = line.split()
                if x and not line.startswith(b"%"):
                    yield int(x[0]) - 1, int(x[1]) - 1, float(x[2]) if kinds["field"] != "pattern" else 1.0, float(x[3]) if kinds["field"] == "complex" else 0.0


def _array(rows, m: int, n: int, kinds: dict[str, str]) -> Iterator[tuple]:
    """Column by column; of a symmetric array only the lower triangle is stored."""
    skip = {"general": None, "skew-symmetric": 1}.get(kinds["symmetry"], 0)
    for col in range(n):
        for row in range(0 if skip is None else col + skip, m):
            x = next(rows)
            yield row, col, float(x[0]), float(x[1]) if kinds["field"] == "complex" else 0.0


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixMarketSource)


def _body(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """What the banner says, and the lines that are neither comments nor blank, with their file, block and order (i) in it."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    kinds = parse_banner(lines.where("startswith(value, '%%MatrixMarket')").first()[0])
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    return kinds, placed.where(~F.startswith("value", F.lit("%")))


def _size_line(body: DataFrame) -> str:
    """The first line of the first block of the first file."""
    return body.agg(F.min(F.struct("file", "block", "i", "value"))["value"]).first()[0]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Large coordinate files (or folders of parts) of any store by Spark's text reader, in parallel.

    The size line is the first after the comments; of lines equal to it one is left out. A file that
    has another number of entries than its size line says is an error.
    """
    kinds, body = _body(spark, path)
    if kinds["layout"] != "coordinate":
        raise ValueError("only coordinate files are read in parallel")
    size = _size_line(body)
    found = body.agg(F.count("*").alias("n"), F.sum((F.col("value") == size).cast("long")).alias("again")).first()
    if len(size.split()) != 3 or int(size.split()[2]) != found["n"] - 1:
        raise ValueError(f"no size line for {found['n'] - 1} entries")
    lines = body.where(F.col("value") != size).select("value")
    p = F.split(F.trim("value"), r"\s+")
    val = F.lit(1.0) if kinds["field"] == "pattern" else p[2].cast("double")
    imag = p[3].cast("double") if kinds["field"] == "complex" else F.lit(0.0)
    columns = [(p[0].cast("int") - 1).alias("row"), (p[1].cast("int") - 1).alias("col"), val.alias("val"), imag.alias("imag")]
    if found["again"] > 1:
        lines = lines.union(spark.range(found["again"] - 1).select(F.lit(size).alias("value")))
    return lines.select(*columns)


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """row, col, val, imag of files in the array layout (or folders of their parts), in parallel.

    A value's place follows from the number of its line. Lines are counted in each block that
    Spark reads and the blocks' counts summed, so that no task numbers more than a block. Of a
    symmetric file the lower triangle is given, as it stands there; a skew-symmetric one has no
    diagonal. A file that has another number of values than its size says is an error.
    """
    with Scratch(spark) as scratch:
        kinds, body = _body(spark, path)
        if kinds["layout"] != "array":
            raise ValueError("not in the array layout")
        body = scratch.table(body)
        m, n = (int(x) for x in _size_line(body).split())
        counts = body.groupBy("file", "block").agg(F.count("*").alias("n"))
        before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
        base = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each block
        own = F.row_number().over(Window.partitionBy("file", "block").orderBy("i"))
        k = F.col("base") + F.col("own") - 2
        rows = body.withColumn("own", own).join(base, ["file", "block"]).select(k.alias("k"), F.split(F.trim("value"), r"\s+").alias("p")).where("k >= 0")
        skew = int(kinds["symmetry"] == "skew-symmetric")
        if kinds["symmetry"] == "general":
            total, col, row = m * n, F.expr(f"k div {max(m, 1)}"), F.col("k") % max(m, 1)
        else:
            # column c of the triangle begins after c * tall - c * (c - 1) / 2 values; the root is right but for rounding
            tall = m - skew
            total = tall * (tall + 1) // 2
            begin = lambda c: c * tall - F.floor(c * (c - 1) / 2)
            near = F.floor((2 * tall + 1 - F.sqrt(F.greatest(F.lit(0.0), F.lit(float(2 * tall + 1)) ** 2 - 8 * F.col("k")))) / 2)
            col = F.when(begin(near) > F.col("k"), near - 1).when(begin(near + 1) <= F.col("k"), near + 1).otherwise(near)
            row = F.col("k") - begin(F.col("c")) + F.col("c") + skew
        imag = F.col("p")[1].cast("double") if kinds["field"] == "complex" else F.lit(0.0)
        placed = rows.withColumn("c", col).select(row.cast("int").alias("row"), F.col("c").cast("int").alias("col"), F.col("p")[0].cast("double").alias("val"), imag.alias("imag"))
        placed = cut(placed)
        if placed.count() != total:
            raise ValueError(f"{placed.count()} values instead of {total}")
        return placed


def write_array(coo: DataFrame, path: str, rows: int, cols: int, symmetry: str = "general") -> None:
    """A folder of text parts that read in order make one file in the array layout, column by column.

    coo(row, col, val) has every value of the matrix, or of a symmetric one those of the lower
    triangle (without the diagonal if it is skew-symmetric).
    """
    head = [banner("array", "real", symmetry), f"{rows} {cols}"]
    lines = coo.select("row", "col", F.col("val").cast("double").cast("string").alias("value"), F.lit(1).alias("at"))
    first = coo.sparkSession.createDataFrame([(-1, -1, "\n".join(head), 0)], "row int, col int, value string, at int")
    lines.union(first).repartitionByRange("at", "col", "row").sortWithinPartitions("at", "col", "row").select("value").write.text(path)


def mirrored(coo: DataFrame, symmetry: str = "symmetric") -> DataFrame:
    """The whole matrix from the stored triangle of a symmetric, skew-symmetric or hermitian file."""
    sign = -1.0 if symmetry == "skew-symmetric" else 1.0
    turn = -1.0 if symmetry in ("skew-symmetric", "hermitian") else 1.0
    other = coo.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("val") * sign).alias("val"), *([(F.col("imag") * turn).alias("imag")] if "imag" in coo.columns else []))
    return coo.union(other)


def entry_lines(coo: DataFrame, pattern: bool = False) -> DataFrame:
    """One text line for each entry, ids from 1, values so that they read back exactly."""
    ids: list[Column] = [(F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string")]
    return coo.select("row", "col", F.concat_ws(" ", *ids, *([] if pattern else [F.col("val").cast("double").cast("string")])).alias("value"))


def write(coo: DataFrame, path: str, rows: int, cols: int, symmetry: str = "general", pattern: bool = False) -> None:
    """A folder of text parts that read in order make one file: banner and size in the first.

    Entries stand in column order, dealt out by ranges of columns, so that the parts can be
    written by many tasks.
    """
    spark = coo.sparkSession
    n = coo.count()
    head = [banner("coordinate", "pattern" if pattern else "real", symmetry), f"{rows} {cols} {n}"]
    lines = entry_lines(coo, pattern).withColumn("at", F.lit(1))
    first = spark.createDataFrame([(-1, -1, "\n".join(head), 0)], "row int, col int, value string, at int")
    lines.union(first).repartitionByRange("at", "col", "row").sortWithinPartitions("at", "col", "row").select("value").write.text(path)

