"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partition.

A row's key is the hash of its text, then a hash of its id; so equal texts stand together. Keys
are drawn with probability in proportion to size, and quantiles of the sample cut the key space
into many fine ranges of about equal bytes. Sizes of the ranges are then counted exactly,
overfull ranges are sampled again and subdivided, and consecutive ranges fill the shards.
A boundary falls between groups of equal texts, but for groups that fill whole ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

_LAST = np.int64(2**63 - 1)


@dataclass
class Splitters:
    """Upper bounds (h, g) of all ranges but the last, in order."""

    h: np.ndarray
    g: np.ndarray

    def range_of(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The range of each key: the number of upper bounds below it."""
        lo, hi = np.searchsorted(self.h, h, side="left"), np.searchsorted(self.h, h, side="right")
        out = lo.copy()
        # several bounds of one h cut a group of equal texts
        for start in np.unique(lo[hi > lo]):
            rows = np.flatnonzero((lo == start) & (hi > lo))
            stop = hi[rows[0]]
            out[rows] = start + np.searchsorted(self.g[start:stop], g[rows], side="left")
        return out


def _quantiles(h: np.ndarray, g: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """At most parts - 1 bounds at equal steps through sampled keys.

    A group of equal texts that holds one bound isn't cut: the bound is put behind it.
    """
    if parts < 2 or not len(h):
        return h[:0], g[:0]
    order = np.lexsort((g, h))
    at = np.unique((np.arange(1, parts) * len(h)) // parts)
    h, g = h[order][at], g[order][at].copy()
    g[np.append(h[1:] != h[:-1], True)] = _LAST
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return h[keep], g[keep]


def _ranged(rows: DataFrame, splitters: Splitters) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(splitters)
    names = rows.columns

    def run(batches):
        for batch in batches:
            h, g = (batch.column(names.index(c)).to_numpy() for c in ("h", "g"))
            out = held.value.range_of(h, g).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, "range"])

    return rows.mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in rows.dtypes), "range int"]))


def _sample(rows: DataFrame, wanted: int, total: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """About `wanted` keys (their number is the driver's bound), by size."""
    chance = F.pmod(F.xxhash64("h", "g", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.where(chance < F.col("size") * F.lit(wanted / max(total, 1))).select("h", "g").collect()
    return np.array([r["h"] for r in drawn], np.int64), np.array([r["g"] for r in drawn], np.int64)


def _chains(ranges: list[int], splitters: Splitters) -> list[list[int]]:
    """Runs of ranges between which a group of equal texts is cut."""
    out: list[list[int]] = []
    for k in ranges:
        cut = out and all(splitters.g[i] != _LAST for i in range(out[-1][-1], k))
        if cut:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 8, ranges_per_shard: int = 256, samples_per_range: int = 16, overfull: float = 2.0, rounds: int = 3, most_whole: float = 0.1) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard and slot; the shards near equal in bytes.

    size is the text's UTF-8 bytes (a null text has none) plus 1. Slots count from 0 in each
    shard without gaps, in order of key. Equal texts are in one shard unless they fill whole
    ranges, of which there are shards * ranges_per_shard. Null ids are ids like others; repeated
    rows stand next to each other; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("g"),
    )
    rows = written(rows, "shard-keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = shards * ranges_per_shard
    splitters = Splitters(*_quantiles(*_sample(rows, parts * samples_per_range, total, 0), parts))
    for turn in range(1, rounds + 1):
        ranged = _ranged(rows, splitters)
        # a row for each range
        sizes = {r["range"]: (r["bytes"], r["rows"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
        full = [k for k, (b, n) in sizes.items() if b > overfull * total / parts and n > 1]
        if not full or turn == rounds:
            break
        bytes_full = sum(sizes[k][0] for k in full)
        h, g = _sample(ranged.where(F.col("range").isin(full)), len(full) * 8 * samples_per_range, bytes_full, turn)
        where = splitters.range_of(h, g)
        more = [_quantiles(h[where == k], g[where == k], 1 + int(sizes[k][0] * parts / total)) for k in full]
        h = np.concatenate([splitters.h, *(x for x, _ in more)])
        g = np.concatenate([splitters.g, *(x for _, x in more)])
        both = np.unique(np.stack([h, g]), axis=1)
        if both.shape[1] == len(splitters.h):
            break
        splitters = Splitters(both[0], both[1])
    places, before, counts = [], 0, [0] * shards
    for chain in _chains(sorted(sizes), splitters):
        size = sum(sizes[k][0] for k in chain)
        whole = size <= most_whole * total / shards
        middle = before + size / 2
        for k in chain:
            own, n = sizes[k]
            at = middle if whole else before + own / 2
            shard = min(shards - 1, int(at * shards // max(total, 1)))
            places.append((k, shard, counts[shard]))
            counts[shard] += n
            before += own
    table = rows.sparkSession.createDataFrame(places, "range int, shard int, first long")
    order = "row_number() over (partition by range order by h, g, doc_id) - 1"
    # the table has a row for each range
    out = ranged.withColumn("at", F.expr(order)).join(F.broadcast(table), "range")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).alias("slot"))
