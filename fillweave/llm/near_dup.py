"""Near duplicates: MinHash with tensored banding, candidates verified on full shingle sets.

A document's set has its distinct 5-word shingles. Two collections of m small hash groups are
taken of each set; each group joins `width` minhashes. A table key is a pair (group i of the
first collection, group j of the second), so 2*m*width minhashes give the m*m keys that plain
banding would want 2*m*m*width minhashes for. With m = 12 and width = 2 a pair of similarity
0.75 shares a key with probability (1 - (1 - 0.75**2)**12)**2 > 0.9999.

Documents of equal sets form classes, and only classes are compared:

1. Groups that two classes or more have form the table keys. In each key's bucket every member is
   tried with the smallest one, in larger buckets also with the largest one; links are verified
   and nodes that they connect get a common name.
2. Only buckets whose members still have different names go on. Their members are compared pair by
   pair, block against block. Rows are laid out by the first half of the key and the second half
   is asked of each pair, so that a node takes a row for each group and not for each key.

A candidate goes on if enough bytes of two sketches agree (128 further minhashes, a byte each);
a pair of the similarity wanted fails that with a probability below one in a hundred thousand.
In step 2, where such pairs can be many, the smallest hashes of the two sets are compared instead.
Every link is confirmed by the sizes of intersection and union of the whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut, documents

_U = np.uint64
#: Bytes of a sketch, and the 64-bit words that hold them.
SKETCH = 128
WORDS = [f"q{i}" for i in range(SKETCH // 8)]


def shingle_sets(piece: tv.Piece, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct word k-shingles as sorted 64-bit hashes, end to end, with bounds.

    A-Z is read as a-z. A row of fewer than k words has its whole sequence as its one shingle;
    a row without words has none.
    """
    w = tv.words(piece)
    h = tv.span_hashes(piece.data, w.starts, w.ends, tv.LOWER_VALUES)
    counts, first = w.counts, w.bounds[:-1]
    long = np.maximum(counts - k + 1, 0)
    n = max(len(h) - k + 1, 0)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        rolled = tv.mix(rolled + h[j : j + n]) if j == 0 else rolled * _U(0x9E3779B97F4A7C15) + h[j : j + n]
    rolled = tv.mix(rolled)
    sets = []
    for a, c, m in zip(first.tolist(), counts.tolist(), long.tolist(), strict=True):
        if m:
            sets.append(np.unique(rolled[a : a + m]))
        elif c:
            whole = np.full(1, c, dtype=np.uint64)
            for x in h[a : a + c]:
                whole = tv.mix(whole + x)
            sets.append(whole)
        else:
            sets.append(rolled[:0])
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else rolled[:0]), bounds


def _fold(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    sums = np.zeros((2, len(hashes) + 1), dtype=np.uint64)
    np.cumsum(tv.mix(hashes), out=sums[0, 1:])
    np.cumsum(tv.mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5)), out=sums[1, 1:])
    return tuple(tv.mix(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)


def _group_hashes(hashes: np.ndarray, bounds: np.ndarray, groups: int, width: int) -> np.ndarray:
    """For each row a 64-bit word for each i: group i of the first collection above that of the second.

    A group has 32 bits of `width` minhashes; rows with empty sets get zeros.
    """
    n = len(bounds) - 1
    out = np.zeros((n, 2 * groups), dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        starts = bounds[:-1][full]
        seeds = tv.mix(np.arange(1, 4 * groups * width + 1, dtype=np.uint64))
        for g in range(2 * groups):
            value = np.zeros(len(full), dtype=np.uint64)
            for i in range(width):
                k = 2 * (g * width + i)
                least = np.minimum.reduceat((hashes ^ seeds[k]) * (seeds[k + 1] | _U(1)), starts)
                value = tv.mix(value + least)
            out[full, g] = value >> _U(32)
    return (out[:, :groups] << _U(32)) | out[:, groups:]


def _sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row SKETCH minhashes of a byte each, as 64-bit words; rows with empty sets get zeros."""
    out = np.zeros((len(bounds) - 1, SKETCH), dtype=np.uint8)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        starts = bounds[:-1][full]
        seeds = tv.mix(np.arange(1 << 20, (1 << 20) + 2 * SKETCH, dtype=np.uint64)).astype(np.uint32)
        half = (hashes >> _U(32)).astype(np.uint32)
        work = np.empty_like(half)
        for i in range(SKETCH):
            np.bitwise_xor(half, seeds[2 * i], out=work)
            np.multiply(work, seeds[2 * i + 1] | np.uint32(1), out=work)
            out[full, i] = (np.minimum.reduceat(work, starts) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out.view(np.uint64)


def signatures(docs: DataFrame, groups: int = 12, width: int = 2, k: int = 5) -> DataFrame:
    """doc_id, text_key, the set's size, its two digests, p0.. (the hash groups) and q0.. (the sketch)."""
    names = [f"p{i}" for i in range(groups)] + WORDS

    def run(batches):
        for batch in batches:
            for piece in tv.pieces(batch.column(2)):
                hashes, bounds = shingle_sets(piece, k)
                s1, s2 = _fold(hashes, bounds)
                words = np.hstack([_group_hashes(hashes, bounds, groups, width), _sketches(hashes, bounds)]).view(np.int64)
                own = [batch.column(c).slice(piece.lo, piece.n) for c in (0, 1)]
                columns = [pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(bounds)), pa.array(s1), pa.array(s2), *columns], ["doc_id", "text_key", "n_shingles", "s1", "s2", *names])

    keyed = documents(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "text_key", "n_shingles", "s1", "s2", *names]))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are at least `percent` per cent alike."""

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, dtype=bool)
            sides = []
            for c in ("ta", "tb"):
                sets = []
                for piece in tv.pieces(batch.column(c)):
                    hashes, bounds = shingle_sets(piece, k)
                    sets += [hashes[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                sides.append(sets)
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            for i, (x, y) in enumerate(zip(*sides, strict=True)):
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the connected components of edges (a, b), named by their smallest node.

    Each round takes the smallest name among a node's neighbours and then the name of that name,
    so that long chains shrink quickly; it ends when no name changes.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp"))
    names = cut(names)
    while True:
        near = both.join(names.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = names.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        far = names.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        step = cut(step.join(far, "comp").select("node", "old", F.least("comp", "far").alias("comp")))
        names = step.select("node", "comp")
        if step.where("old <> comp").isEmpty():
            return names


def partly_named(links: DataFrame) -> DataFrame:
    """node, comp: a node that each end of the links (a, b) is connected with, its own or a smaller one.

    Two steps towards the smallest node: enough for most stars, and cheaper than components().
    Nodes of one name are connected; connected nodes may have two names.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("comp"))
    far = near.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
    return near.join(far, "comp").select("node", F.least("comp", "far").alias("comp"))


def agreeing_bytes(percent: int, miss: float = 1e-5) -> int:
    """How many bytes of two sketches agree at least, but for a chance of `miss`, if sets are `percent` per cent alike."""
    s, below = percent / 100, 0.0
    for n in range(SKETCH + 1):
        below += math.comb(SKETCH, n) * s**n * (1 - s) ** (SKETCH - n)
        if below > miss:
            return n
    return SKETCH


def _agreement() -> Column:
    """How many bytes agree of the sketches in columns q0_a.. and q0_b.. ."""
    total = F.lit(SKETCH)
    for c in WORDS:
        x = F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        # the lowest bit of each byte now tells if any bit of it is set
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def _likely(pairs: DataFrame, heads: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose sketches agree in at least `least` bytes."""
    for side in "ab":
        pairs = pairs.join(heads.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in WORDS)), side)
    return pairs.where(_agreement() >= least).select("a", "b")


def _tags(heads: DataFrame, groups: int) -> DataFrame:
    """node, t and g for each hash group of both collections; t is its number, from `groups` on of the second."""
    words = [F.col(f"p{i}") for i in range(groups)]
    halves = [F.shiftrightunsigned(w, 32) for w in words] + [w.bitwiseAND(F.lit(0xFFFFFFFF)) for w in words]
    rows = heads.select("node", F.posexplode(F.array(*halves)).alias("t", "half"))
    return rows.select("node", F.col("t").cast("int").alias("t"), F.xxhash64("t", "half").alias("g"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Pairs (node, centre) as (a, b) with a < b, each once."""
    return rows.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _with_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    return rows.join(names, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _smallest(texts: DataFrame, n: int, k: int) -> DataFrame:
    """node, and 16 bits of each of the n smallest hashes of its set (of all, if it has no more)."""

    def run(batches):
        for batch in batches:
            for piece in tv.pieces(batch.column(1)):
                hashes, bounds = shingle_sets(piece, k)
                counts = np.minimum(np.diff(bounds), n)
                at = np.concatenate([[0], np.cumsum(counts)])
                low = hashes[np.repeat(bounds[:-1] - at[:-1], counts) + np.arange(at[-1])].astype(np.uint16).view(np.int16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.lo, piece.n), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(low))], ["node", "low"])

    return texts.select("node", "text").mapInArrow(run, "node long, low array<short>")


def shared_counts(low: np.ndarray, bounds: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """For each two rows how many values they share at most; row r has the values low[bounds[r] : bounds[r + 1]].

    Equal values of one row stand for different hashes: as many as both rows repeat may be shared too.
    """
    m = len(bounds) - 1
    row = np.repeat(np.arange(m), np.diff(bounds))
    own = np.unique((row.astype(np.int64) << 16) | low.view(np.uint16))
    repeats = np.diff(bounds) - np.bincount(own >> 16, minlength=m)
    row, (_, value, often) = own >> 16, np.unique(own & 0xFFFF, return_inverse=True, return_counts=True)
    keep = often[value] > 1
    number = np.cumsum(often > 1) - 1
    row, value, values = row[keep], number[value[keep]], int(number[-1]) + 1 if len(number) else 0
    out = np.zeros((m, m), dtype=np.float32)
    for lo in range(0, values, chunk):
        here = (value >= lo) & (value < lo + chunk)
        has = np.zeros((m, min(chunk, values - lo)), dtype=np.float32)
        has[row[here], value[here] - lo] = 1
        out += has @ has.T
    return out.astype(np.int64) + np.minimum(repeats[:, None], repeats)


def _run_pairs(t: int, first: int, second: int, block: np.ndarray, node: np.ndarray, comp: np.ndarray, n: np.ndarray, groups: np.ndarray, low: np.ndarray, bounds: np.ndarray, percent: int, smallest: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one run: between the rows of block `first` and of block `second` (maybe the same) of a bucket."""
    both = shared_counts(low, bounds)
    small, large = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
    exact = 100 * both >= percent * (small + large - both)
    ok = np.where(large <= smallest, exact, (both >= share * np.minimum(small, smallest)) & (100 * small >= percent * large))
    ok &= (comp[:, None] != comp) & (block[:, None] == first) & (block == second)
    if first == second:
        ok &= node[:, None] < node
    i, j = np.nonzero(ok)
    same = groups[i] ^ groups[j]
    tops = (same >> _U(32)) == 0
    here = (np.argmax(tops, axis=1) == t) & tops.any(axis=1) & ((same & _U(0xFFFFFFFF)) == 0).any(axis=1)
    return np.minimum(node[i], node[j])[here], np.maximum(node[i], node[j])[here]


def _in_open_buckets(named: DataFrame, heads: DataFrame, texts: DataFrame, percent: int, groups: int, k: int, smallest: int, share: float, rows_in_block: int) -> DataFrame:
    """All pairs (a, b) of different components that share a table key and seem alike enough, each once.

    named(node, comp, t, g) are the first halves of the nodes' keys. Buckets are those of the first half of the key; the second half is asked of each pair, and a
    pair is made at the first such half that it shares. Every two blocks of a bucket are a run of
    at most 2 * rows_in_block rows or so, so a large bucket is many tasks' work. Pairs are told
    apart by their smallest hashes: for sets that have no more of them this is the exact test.
    Larger sets that are alike enough share fewer than `share` of them with a probability below
    one in a million (256 of them, similarity 0.75, share 0.6).
    """
    sizes = named.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"))
    sizes = cut(sizes.where("lo <> hi").select("g", F.ceil(F.col("size") / rows_in_block).cast("int").alias("blocks")))
    rest = cut(named.join(sizes, "g"))
    own = heads.select("node", F.col("n_shingles").alias("n"), F.array(*(f"p{i}" for i in range(groups))).alias("groups"))
    own = own.join(_smallest(texts.join(rest.select("node").distinct(), "node", "left_semi"), smallest, k), "node")
    block = F.pmod(F.hash("node"), F.col("blocks"))
    rest = rest.select("g", "t", "node", "comp", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).join(own, "node")
    rest = rest.select("g", "t", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node", "comp", "n", "groups", "low")

    def compare(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            keys = np.stack([held.column(c).to_numpy().astype(np.int64) for c in range(4)])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if len(ends):
                yield from runs(held, keys, np.concatenate([[0], ends]))
                held = held.slice(int(ends[-1]))
        if held is not None and held.num_rows:
            keys = np.stack([held.column(c).to_numpy().astype(np.int64) for c in range(4)])
            yield from runs(held, keys, np.array([0, held.num_rows]))

    def runs(held, keys, bounds):
        block, node, comp, n = (held.column(c).to_numpy() for c in range(4, 8))
        words = held.column(8).flatten().to_numpy().view(np.uint64).reshape(-1, groups)
        counts = np.asarray(held.column(9).value_lengths()).astype(np.int64)
        low, at = held.column(9).flatten().to_numpy(), np.concatenate([[0], np.cumsum(counts)])
        a, b = [], []
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if (comp[x:y] != comp[x]).any():
                _, t, first, second = keys[:, x].tolist()
                found = _run_pairs(t, first, second, block[x:y], node[x:y], comp[x:y], n[x:y], words[x:y], low[at[x] : at[y]], at[x : y + 1] - at[x], percent, smallest, share)
                a.append(found[0])
                b.append(found[1])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    key = ["g", "t", "first", "second"]
    return rest.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "a long, b long")


def _head_texts(docs: DataFrame, shown: DataFrame, involved: DataFrame) -> DataFrame:
    """node, text: one row for each of the involved classes; involved(node, no_id, key, text_key) names the row that stands for it.

    Rows that share both id and text are many copies of one; they are looked up apart and each
    taken once, so that no class has two texts.
    """
    place = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", "text_key").alias("key")]
    again = cut(shown.where("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select(*place, "text_key"))
    keys = ["no_id", "key", "text_key"]
    rows = documents(docs).withColumn("text_key", F.xxhash64("text")).select(*place, "text_key", "text")
    single = rows.join(involved.join(again, keys, "left_anti"), keys).select("node", "text")
    repeated = rows.join(involved.join(again, keys, "left_semi"), keys).groupBy("node").agg(F.first("text").alias("text"))
    return cut(single.union(repeated))


def classes_and_members(docs: DataFrame, percent: int, groups: int, width: int, k: int, smallest: int = 256, share: float = 0.6, rows_in_block: int = 512, second_centre: int = 8) -> tuple[DataFrame, DataFrame]:
    """(members, classes): doc_id, text_key, n_shingles, s1, s2 of each row; node, s2, n_shingles, rep and comp of each class of equal sets.

    rep is the class's smallest doc_id, null if it has none; comp names its component.
    """
    shown = cut(signatures(docs, groups, width, k))
    words = [c for c in shown.columns if c[0] in "pq"]
    # a text is found again by its id and its hash
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", "text_key").alias("key"), "text_key"))
    # cut off from the grouping, so that Spark can split a hot group's rows when tables are joined
    heads = cut(shown.where("n_shingles > 0").groupBy(F.col("s1").alias("node"), "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), head.alias("head"), *(F.first(c).alias(c) for c in words)))

    # table keys of the groups that more than one class has
    tags = _tags(heads, groups)
    often = cut(tags.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    shared = tags.join(often, "g", "left_semi").groupBy("node").agg(F.collect_set(F.struct("t", "g")).alias("tg"))
    side = lambda first: F.filter("tg", lambda x: (x["t"] < groups) == F.lit(first))
    shared = cut(shared.select("node", side(True).alias("one"), side(False).alias("two")).where("size(one) > 0 and size(two) > 0"))
    keys = shared.select("node", F.explode("one.g").alias("x"), "two").select("node", "x", F.explode("two.g").alias("y"))
    keys = keys.select("node", F.xxhash64("x", "y").alias("key"))
    busy = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1")
    busy = cut(busy.select("key", F.when(F.col("n") > second_centre, F.array("lo", "hi")).otherwise(F.array("lo")).alias("centres")))
    tried = _ordered(keys.join(busy, "key").select("node", F.explode("centres").alias("centre")))

    texts = _head_texts(docs, shown, heads.join(shared.select("node"), "node", "left_semi").select("node", "head.*"))

    links = cut(_verified(_likely(tried, heads, agreeing_bytes(percent)), texts, percent, k))
    names = cut(partly_named(links))

    # what is still apart then is compared pair by pair, each pair once
    halves = shared.select("node", F.explode("one").alias("x")).select("node", "x.t", "x.g")
    pairs = cut(_in_open_buckets(_with_names(halves, names), heads, texts, percent, groups, k, smallest, share, rows_in_block))
    names = components(links.union(_verified(pairs, texts, percent, k)))
    return shown.select("doc_id", "text_key", "n_shingles", "s1", "s2"), _with_names(heads.select("node", "s2", "n_shingles", "rep"), names)


def near_duplicates(docs: DataFrame, percent: int = 75, groups: int = 12, width: int = 2, k: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept.

    Documents whose sets have 100 * intersection >= percent * union are linked; component_id is
    the smallest doc_id reachable. A null or empty text, or one without words, has an empty set
    and is linked with nothing. A null doc_id is no smallest id, but links like any other: such a
    row gets the smallest doc_id that it reaches, null if there is none, and is kept only if that
    is null. Repeated rows share a component and, as they share its id too, are kept alike.
    Texts of any length are compared whole. An empty table gives no rows, and columns other than
    doc_id and text don't matter.
    """
    members, classes = classes_and_members(docs, percent, groups, width, k)
    classes = cut(classes)
    least = classes.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = cut(classes.join(least, "comp").select(F.col("node").alias("s1"), "s2", "n_shingles", "component_id"))
    linked = members.join(named, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_documents(docs: DataFrame, percent: int = 75, groups: int = 12, width: int = 2, k: int = 5) -> DataFrame:
    """One document of each group of near duplicates, with all its columns.

    The one of the smallest doc_id stays, or where no id is there that of the smallest text hash;
    of rows equal in id and text one stays. Where two rows of one id have different texts each is
    judged by its own. Texts without words are linked with nothing and stay, repeated or not. An
    empty table gives no rows; extra columns are carried along, whatever their names.
    """
    members, classes = classes_and_members(docs, percent, groups, width, k)
    classes = cut(classes.select(F.col("node").alias("s1"), "s2", "n_shingles", "comp"))
    rows = members.where("n_shingles > 0").groupBy("doc_id", "text_key", "s1", "s2", "n_shingles").agg(F.count("*").alias("n"))
    rows = cut(rows.join(classes, ["s1", "s2", "n_shingles"]).select("doc_id", "text_key", "comp", "n"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "text_key")
    first = cut(rows.groupBy("comp").agg(F.min(order).alias("first")))
    stays = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))
    # only rows that go, or that have their like, are looked up
    said = rows.join(first, "comp").select(F.coalesce("doc_id", "text_key").alias("key"), F.col("text_key").alias("tkey"), F.col("doc_id").isNull().alias("no_id"), stays.alias("stays"), "n").where("not stays or n > 1")
    said = said.groupBy("key", "tkey", "no_id").agg(F.max("stays").alias("stays"))
    text_key = F.xxhash64(F.col("text").cast("string"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), text_key).alias("key"), text_key.alias("tkey"), F.col("doc_id").isNull().alias("no_id"))
    judged = row.join(cut(said), ["key", "tkey", "no_id"], "left")
    single = judged.where("stays is null").select("row.*")
    again = judged.where("stays").groupBy("key", "tkey", "no_id").agg(F.first("row").alias("row")).select("row.*")
    return single.union(again)
