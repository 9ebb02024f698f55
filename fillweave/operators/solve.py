"""Conjugate gradients for symmetric positive definite matrices, one sparse product for each step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


@dataclass
class Solution:
    """x(idx, val), the steps taken, and the 2-norm of the residual."""

    x: DataFrame
    steps: int
    residual: float


def conjugate_gradient(coo: DataFrame, b: DataFrame, tolerance: float = 1e-5, most_steps: int = 2048) -> Solution:
    """Solve A x = b for a full symmetric matrix coo(row, col, val) and a vector b(idx, val).

    Ends when the residual's norm is at most tolerance times b's, or after most_steps. The
    vectors x, r, p stay in one table; the driver sees three numbers for each step.
    """
    entries = cut(coo.select("row", F.col("col").alias("idx"), "val"))
    state = cut(b.select("idx", F.lit(0.0).alias("x"), F.col("val").cast("double").alias("r"), F.col("val").cast("double").alias("p")))
    rr = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    least = tolerance * tolerance * rr
    steps = 0
    while steps < most_steps and rr > least:
        product = entries.join(state.select("idx", "p"), "idx").groupBy(F.col("row").alias("idx")).agg(F.sum(F.col("val") * F.col("p")).alias("ap"))
        both = cut(state.join(product, "idx", "left").withColumn("ap", F.coalesce("ap", F.lit(0.0))))
        alpha = rr / both.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        moved = both.select("idx", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        now = moved.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        beta, rr = now / rr, now
        state = cut(moved.select("idx", "x", "r", (F.col("r") + beta * F.col("p")).alias("p")))
        steps += 1
    return Solution(state.select("idx", F.col("x").alias("val")), steps, rr**0.5)
