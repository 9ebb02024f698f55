"""Sparse matrices as `coo(row, col, val)`: layouts, transposes, halves, sums, products, norms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Entries that one task adds up.
TASK_ROWS = 500_000


def transpose(coo: DataFrame) -> DataFrame:
    return coo.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def half(coo: DataFrame, lower: bool = True) -> DataFrame:
    """One triangle, the diagonal included."""
    return coo.where("row >= col" if lower else "row <= col")


def full(coo: DataFrame) -> DataFrame:
    """A symmetric matrix from one of its triangles."""
    return coo.union(transpose(coo.where("row <> col")))


def task_parts(rows: int) -> int | None:
    """Partitions in which no task adds up more than about TASK_ROWS of so many entries; None where the session's own number will do."""
    return -(-rows // TASK_ROWS) if rows > 8 * TASK_ROWS else None


def dealt(coo: DataFrame, parts: int | None) -> DataFrame:
    """Entries by place in so many partitions; None leaves them as they are."""
    return coo.repartition(parts, "row", "col") if parts else coo


def summed(coo: DataFrame, parts: int | None = None) -> DataFrame:
    """Entries of the same place added up, in so many partitions (see task_parts)."""
    return dealt(coo, parts).groupBy("row", "col").agg(F.sum("val").alias("val"))


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0, parts: int | None = None) -> DataFrame:
    """alpha * a + beta * b; zeros that arise are kept."""
    scaled = lambda x, s: x.select("row", "col", (F.col("val") * F.lit(float(s))).alias("val"))
    return summed(scaled(a, alpha).union(scaled(b, beta)), parts)


def symmetric(coo: DataFrame, lower: bool = True, parts: int | None = None) -> DataFrame:
    """One triangle of (A + A') / 2."""
    return half(add(coo, transpose(coo), 0.5, 0.5, parts), lower)


def permuted(coo: DataFrame, perm: DataFrame) -> DataFrame:
    """P A P': entry (i, j) goes to the new positions of i and j; perm(new_pos, v)."""
    rows = perm.select(F.col("v").alias("row"), F.col("new_pos").alias("r"))
    cols = perm.select(F.col("v").alias("col"), F.col("new_pos").alias("c"))
    return coo.join(rows, "row").join(cols, "col").select(F.col("r").alias("row"), F.col("c").alias("col"), "val")


def permuted_half(coo: DataFrame, perm: DataFrame, lower: bool = True) -> DataFrame:
    """One triangle of a symmetric matrix, permuted and put into one triangle again."""
    p = permuted(coo, perm)
    a, b = (F.greatest, F.least) if lower else (F.least, F.greatest)
    return p.select(a("row", "col").alias("row"), b("row", "col").alias("col"), "val")


def csr_rows(coo: DataFrame) -> DataFrame:
    """row, its columns in ascending order, and their values; repeated entries are kept."""
    return coo.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias("entries")).select("row", F.col("entries.col").alias("cols"), F.col("entries.val").alias("vals"))


def pointers(coo: DataFrame, by: str = "row") -> DataFrame:
    """The compressed layout's pointer of each row (or column) that has entries, and its count."""
    counts = coo.groupBy(F.col(by).alias("id")).agg(F.count("*").alias("n")).withColumn("part", F.expr("id div 65536"))
    totals = counts.groupBy("part").agg(F.sum("n").alias("t"))
    base = totals.select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("own", own).join(base, "part").select("id", "n", (F.col("base") + F.col("own")).cast("long").alias("pointer"))


def row_sums(coo: DataFrame) -> DataFrame:
    """A times the vector of ones."""
    return coo.groupBy("row").agg(F.sum("val").alias("val"))


def multiply(coo: DataFrame, x: DataFrame) -> DataFrame:
    """A x for a vector x(idx, val); rows without entries are left out."""
    b = x.select(F.col("idx").alias("col"), F.col("val").alias("x"))
    return coo.join(b, "col").groupBy(F.col("row").alias("idx")).agg(F.sum(F.col("val") * F.col("x")).alias("val"))


def residual_norm(coo: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the 2-norm of b - A x for a full matrix."""
    diff = b.select("idx", "val").union(multiply(coo, x).select("idx", -F.col("val")))
    return diff.groupBy("idx").agg(F.sum("val").alias("d")).agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("norm"))


def norms(values: DataFrame) -> DataFrame:
    """One row: largest absolute value, the signed value that has it, and the 2-norm."""
    v = F.col("val")
    return values.agg(F.max(F.abs(v)).alias("max_abs"), F.max_by(v, F.struct(F.abs(v), v)).alias("signed_max"), F.sqrt(F.sum(v * v)).alias("norm2"))


def max_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the largest absolute difference of two vectors; a missing entry counts as 0."""
    both = a.select("idx", "val").union(b.select("idx", -F.col("val"))).groupBy("idx").agg(F.sum("val").alias("d"))
    return both.agg(F.max(F.abs("d")).alias("max_difference"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").join(b.alias("b"), "idx").agg(F.sum(F.col("a.val") * F.col("b.val")).alias("dot"))


def empty_columns(ids: DataFrame, coo: DataFrame) -> DataFrame:
    """Ids (column `id`) that no entry has as its column."""
    return ids.join(coo.select(F.col("col").alias("id")).distinct(), "id", "left_anti")


def diagonal_first(coo: DataFrame) -> DataFrame:
    """For each column whether its first entry is the diagonal."""
    return coo.groupBy("col").agg((F.min("row") == F.col("col")).alias("diagonal_first"))


def diagonal(coo: DataFrame) -> DataFrame:
    return coo.where("row = col").select(F.col("row").alias("idx"), "val")


def equal(a: DataFrame, b: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """One row: entries that only one matrix has, and those whose values differ; NaN differs."""
    x, y = a.select("row", "col", F.col("val").alias("a")), b.select("row", "col", F.col("val").alias("b"))
    both = x.join(y, ["row", "col"], "full_outer")
    one = F.col("a").isNull() | F.col("b").isNull()
    apart = ~one & (F.isnan("a") | F.isnan("b") | (F.abs(F.col("a") - F.col("b")) > tolerance))
    return both.agg(F.count_if(one).alias("unmatched"), F.count_if(apart).alias("different"))


def is_permutation(perm: DataFrame, column: str, n: int) -> DataFrame:
    """One row: whether a column holds each of 0 to n-1 once."""
    c = F.col(column)
    return perm.agg(((F.count("*") == n) & (F.count_distinct(c) == n) & F.coalesce(F.min(c) == 0, F.lit(n == 0)) & F.coalesce(F.max(c) == n - 1, F.lit(n == 0))).alias("ok"))


def inverse(perm: DataFrame) -> DataFrame:
    """perm(new_pos, v) the other way round: the vertex as position."""
    return perm.select(F.col("v").alias("new_pos"), F.col("new_pos").alias("v"))


def expanded(perm: DataFrame, dim: int) -> DataFrame:
    """The permutation of matrix rows from that of blocks of dim rows."""
    each = perm.select("new_pos", "v", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("d"))
    return each.select((F.col("new_pos") * dim + F.col("d")).alias("new_pos"), (F.col("v") * dim + F.col("d")).alias("v"))


def dense_to_coo(rows: DataFrame) -> DataFrame:
    """Non-zero entries of rows(row, vals array)."""
    return rows.select("row", F.posexplode("vals").alias("col", "val")).where("val <> 0")


def one_based(coo: DataFrame) -> DataFrame:
    return coo.select((F.col("row") + 1).alias("row"), (F.col("col") + 1).alias("col"), "val")


def grid_laplacian(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """5-point stencil: -1 at neighbours, 4 on the diagonal (walls count as neighbours)."""
    off = edges.select(F.col("u").alias("row"), F.col("v").alias("col"), F.lit(-1.0).alias("val"))
    return off.union(nodes.select(F.col("v").alias("row"), F.col("v").alias("col"), F.lit(4.0).alias("val")))


def banded(ids: DataFrame, low: float, mid: float, high: float) -> DataFrame:
    """A matrix of three bands over consecutive ids (column `id`)."""
    n = F.col("id")
    each = ids.select(n, F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(float(v)).alias("val")) for d, v in ((-1, low), (0, mid), (1, high))))).alias("e"))
    entries = each.select(n.alias("row"), (n + F.col("e.d")).cast("int").alias("col"), F.col("e.val").alias("val"))
    return entries.join(ids.select(n.alias("col")), "col", "left_semi").select("row", "col", "val")


def poisson3d(n: int, spark) -> DataFrame:
    """7-point stencil on an n * n * n cube, 6 on the diagonal."""
    cells = spark.range(n**3).select(F.col("id").cast("int").alias("row"), *(F.expr(f"cast(id div {n**k} % {n} as int)").alias(c) for k, c in enumerate("xyz")))
    moves = [(c, s, s * n**k) for k, c in enumerate("xyz") for s in (-1, 1)]
    steps = F.array(F.struct(F.lit(0).alias("d"), F.lit(6.0).alias("val")), *(F.when(F.col(c).between(0 if s > 0 else 1, n - 2 if s > 0 else n - 1), F.struct(F.lit(d).alias("d"), F.lit(-1.0).alias("val"))) for c, s, d in moves))
    each = cells.select("row", F.explode(F.array_compact(steps)).alias("e"))
    return each.select("row", (F.col("row") + F.col("e.d")).cast("int").alias("col"), F.col("e.val").alias("val"))


def checked_product(a, b):
    """Overflow-checked product of two longs: null instead of a wrapped value.

    The first factor is compared with the bounds that the second one leaves. try_multiply() throws
    and catches an exception for each product that doesn't fit.
    """
    low, high = F.lit(-(2**63)), F.lit(2**63 - 1)
    over = lambda bound: F.call_function("div", bound, b)
    fits = F.when(b == 0, True).when(b == -1, a != low).when(b > 0, a.between(over(low), over(high))).otherwise(a.between(over(high), over(low)))
    return F.when(fits, a * b)


def checked_sum(a, b):
    return F.try_add(a, b)


def supernodes(coo: DataFrame) -> DataFrame:
    """col and the first column of its supernode, from the entries on and below the diagonal.

    Neighbouring columns merge if the second has the first's rows but the first's diagonal.
    """
    pattern = coo.where("row >= col").groupBy("col").agg(F.sort_array(F.collect_set("row")).alias("rows"))
    nxt = pattern.select((F.col("col") - 1).alias("col"), F.col("rows").alias("next_rows"))
    joined = pattern.join(nxt, "col").where(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))) == F.col("next_rows"))
    merges = joined.select((F.col("col") + 1).cast("int").alias("col"), F.lit(0).alias("starts"))
    flagged = pattern.select("col").join(merges, "col", "left").select("col", F.coalesce("starts", F.lit(1)).alias("starts"), F.expr("col div 65536").alias("part"))
    own = flagged.withColumn("own", F.max(F.when(F.col("starts") == 1, F.col("col"))).over(Window.partitionBy("part").orderBy("col")))
    last = flagged.where("starts = 1").groupBy("part").agg(F.max("col").alias("last"))
    carry = last.select("part", "last")
    parts = flagged.select("part").distinct().join(carry, "part", "left").select((F.col("part") + 1).alias("part"), F.max("last").over(Window.orderBy("part")).alias("before"))
    return own.join(parts, "part", "left").select("col", F.coalesce("own", "before").cast("int").alias("supernode"))
