"""Mixing sources to target weights: entropy balancing, all of it DataFrame expressions.

Each source gets a target of tokens. Document rates w are then chosen to differ as little as
possible from 1 each, by the entropy sum(w * log(w) - w), with the tokens of each source's weighted
documents equal to its target and no rate above a cap. The solution is an exponential tilt,
w = min(cap, exp(lambda * size)) with one multiplier for each source. The multipliers solve the
convex dual, by Newton steps that keep inside a bracket: each is one aggregate over the counts of
documents by source and size, for all sources at once. Rates are then rounded to whole copies:
sizes in descending order take theirs by the running sum of fractions, and what a source is still
off is made up by single copies of the largest documents that fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"


def _key(source: Column) -> Column:
    """A text that sorts as sources do by code point, null after all of them."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def document_sizes(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """doc_id, key (of the source), size in words and h, by which documents of one size are told apart."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col(source_col)).alias("key"), size.alias("size"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("h"))


def _places(sources: DataFrame) -> DataFrame:
    """The sources with their place, from 0, in the order of keys; ranges of keys are counted first."""
    ranged = cut(sources.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return ranged.withColumn("own", own).join(base, "part").withColumn("place", F.col("base") + F.col("own")).drop("part", "own", "base")


def source_targets(sources: DataFrame, most_copies: int) -> DataFrame:
    """sources(key, source_size, weight) with `target`: shares of all tokens by weight, but at most most_copies times the source's size.

    What is above that is shared again by weight until none is above. All sources below their
    limit so have one ratio of target to weight, the level, which rises until no further source
    reaches its limit; each round is one aggregate.
    """
    limit = most_copies * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        at = (limit <= F.lit(level) * F.col("weight")) if full >= 0 else F.lit(False)
        r = sources.agg(F.sum(F.when(~at, F.col("weight"))).alias("w"), F.sum(F.when(at, limit)).alias("t"), F.count(F.when(at, 1)).alias("n")).first()
        if r["n"] == full or not r["w"]:
            break
        full, level = r["n"], (total - (r["t"] or 0)) / r["w"]
    return sources.withColumn("target", F.least(limit.cast("double"), F.lit(float(level)) * F.col("weight")))


def _fixed_sum(x: Column) -> Column:
    """A sum in millionths, which doesn't depend on the order of the rows, so that reruns agree to the last bit."""
    return F.sum((x * 1e6).cast("decimal(38, 0)")).cast("double") / 1e6


def multipliers(counts: DataFrame, sources: DataFrame, most_copies: int, close: float = 1e-7, most_rounds: int = 60) -> DataFrame:
    """The sources with `scale` and `tilt`: a document of a size has the rate min(most_copies, exp(tilt * size / scale)).

    counts(key, size, n) are documents by source and size. The tilt is null where the target is
    the limit (each document has the highest rate) or the source has no words. A round ends for
    a source whose tokens are as near its target as `close` says.
    """
    worth = F.col("size") * F.col("n")
    facts = counts.where("size > 0").groupBy("key").agg((_fixed_sum(worth * F.col("size").cast("double")) / F.sum(worth)).alias("scale"), F.min("size").alias("least"))
    base = sources.join(facts, "key", "left")
    open_ = base.where((F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < most_copies * F.col("source_size")))
    # at `end` on one side of 0 all rates are at the cap, or so low that the target can't be reached
    end = F.when(F.col("target") < F.col("source_size"), F.log(F.col("target") / F.col("source_size"))).otherwise(math.log(most_copies)) * F.col("scale") / F.col("least")
    state = cut(open_.select("key", "target", "scale", F.least(end, F.lit(0.0)).alias("lo"), F.greatest(end, F.lit(0.0)).alias("hi"), F.lit(0.0).alias("tilt"), F.lit(False).alias("done")))
    z = F.col("size") / F.col("scale")
    tilted = F.exp(F.least(F.col("tilt") * z, F.lit(math.log(most_copies))))
    free = F.col("tilt") * z < math.log(most_copies)
    for _ in range(most_rounds):
        active = state.where("not done")
        if active.isEmpty():
            break
        sums = counts.where("size > 0").join(active, "key").groupBy("key").agg(_fixed_sum(worth * tilted).alias("g"), _fixed_sum(F.when(free, worth * z * tilted).otherwise(0.0)).alias("slope"))
        step = state.join(sums, "key", "left")
        off = F.col("g") - F.col("target")
        lo, hi = F.when(off < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(off > 0, F.col("tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") - F.try_divide(off, F.col("slope"))
        inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
        done = F.col("done") | (F.abs(off) <= close * F.col("target"))
        state = cut(step.select("key", "target", "scale", F.coalesce(lo, "lo").alias("lo"), F.coalesce(hi, "hi").alias("hi"), F.when(done, F.col("tilt")).when(inside, newton).otherwise((lo + hi) / 2).alias("tilt"), done.alias("done")))
    return base.drop("least").join(state.select("key", "tilt"), "key", "left")


def rates(counts: DataFrame, sources: DataFrame, most_copies: int) -> DataFrame:
    """counts with source_size, target and the rate of each size; sources are those of multipliers()."""
    rate = F.when(F.col("tilt").isNotNull(), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(math.log(most_copies)))))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.coalesce(F.least(rate, F.lit(float(most_copies))), F.lit(float(most_copies))))
    return counts.join(sources.select("key", "source_size", "target", "scale", "tilt"), "key").select("key", "size", "n", "source_size", "target", rate.alias("rate"))


def copies_by_size(rated: DataFrame, most_copies: int) -> DataFrame:
    """rated with `copies`: how many copies the n documents of one source and size get together.

    A source's tokens come as near its target as its small documents allow: each round adds (or
    takes away) copies of the largest sizes that still fit into what it is off, which at least
    halves that; the last one takes the copy that leaves least, if any helps. Sizes of one source
    are bounded by the longest document, so they are one window.
    """
    down = Window.partitionBy("key").orderBy(F.desc("size"))
    part = F.col("n") * (F.col("rate") - F.floor("rate"))
    run = F.sum(part).over(down)
    extra = F.floor(run + 0.5) - F.floor(run - part + 0.5)
    c = F.col("n") * F.floor("rate") + F.greatest(F.lit(0), F.least(extra, F.col("n")))
    state, last = cut(rated.withColumn("copies", F.least(c, most_copies * F.col("n")).cast("long"))), False
    while True:
        off = state.groupBy("key").agg(F.max("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("got"))
        off = off.select("key", F.round(F.col("t") - F.col("got")).cast("long").alias("off"))
        near = state.join(off, "key")
        size, far = F.col("size"), F.abs("off")
        room = F.when(F.col("off") > 0, most_copies * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        near = near.withColumn("room", F.when((size > 0) & (size < 2 * far if last else size <= far), room).otherwise(0))
        if last:
            nearest = Window.partitionBy("key").orderBy(F.col("room") == 0, F.abs(size - far), "size")
            take = F.least(F.col("room"), (F.row_number().over(nearest) == 1).cast("long"))
        else:
            before = F.coalesce(F.sum(F.col("room") * size).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            # sizes of 0 have no room
            take = F.least(F.col("room"), F.floor(F.greatest(far - before, F.lit(0)) / F.greatest(size, F.lit(1)))).cast("long")
        step = cut(near.withColumn("take", take))
        changed = not step.where("take > 0").isEmpty()
        if changed:
            state = cut(step.select(*rated.columns, (F.col("copies") + F.signum("off").cast("long") * F.col("take")).alias("copies")))
        if last:
            return state
        last = not changed


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_copies: int = 3, source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, rate, copies and taken (copies times size).

    size counts the words of the text, 0 for null and empty ones, whatever their length. Sources
    by code point, null last, have the weights in turn, repeating; targets are those of
    source_targets(). Documents of one source and size have one rate; which of them get the
    further copy is told by a hash of id and text, so that reruns agree and repeated rows, of
    which any may be the one, get the same copies together. A document without words has no
    effect and one copy. An empty table gives no rows; columns other than doc_id, text and the
    source don't matter.
    """
    held = cut(document_sizes(docs, source_col))
    counts = cut(held.groupBy("key", "size").agg(F.count("*").alias("n")))
    sources = _places(counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut(source_targets(cut(sources.withColumn("weight", weight)), most_copies))
    rated = rates(counts, cut(multipliers(counts, sources, most_copies)), most_copies)
    decided = cut(copies_by_size(rated, most_copies))

    # a size's documents are dealt to as many buckets as a bucket of the largest one has rows
    largest = decided.agg(F.max("n")).first()[0] or 1
    held = held.withColumn("bucket", F.pmod("h", F.lit(max(1, math.isqrt(largest)))))
    more = lambda c: F.expr(f"cast(cast({c} as decimal(19, 0)) * cast(copies % n as decimal(19, 0)) div n as long)")
    order = Window.partitionBy("key", "size").orderBy("bucket")
    share = held.groupBy("key", "size", "bucket").agg(F.count("*").alias("nb")).join(decided, ["key", "size"]).withColumn("run", F.sum("nb").over(order)).withColumn("prev", F.col("run") - F.col("nb"))
    share = share.select("key", "size", "bucket", "source_size", "target", "rate", F.expr("copies div n").alias("base"), (more("run") - more("prev")).alias("further"))
    place = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("h"))
    out = held.join(share, ["key", "size", "bucket"]).withColumn("copies", F.col("base") + (place <= F.col("further")).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
