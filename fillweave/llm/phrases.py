"""Phrase collocation mining: pairs of frequency-ranked words counted in tiles.

Words are counted first. Those that are frequent enough get ids, for the most frequent ones (the
head, of bounded size) their rank, so that frequent pairs lie close together in the square of pairs
of ranks. A task cuts the square into tiles: a tile with many of its pairs is counted by direct
address, in a dense array; the pairs of all others are sorted and counted as coordinates. What
tasks have counted is summed by Spark. Pairs that are frequent enough are ranked in turn and paired
with the word after them, which gives the phrases of three words.

Words and pairs beyond the head keep their 64-bit hash as id, and tasks know those that are frequent
by a bit map of fixed size: a bit that is set by chance costs a count that is thrown away later.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut

_U = np.uint64
_TOP = _U(1 << 63)
#: Bytes that end a piece, and those that part words.
ENDS_PIECE = np.zeros(256, dtype=bool)
ENDS_PIECE[[*b".,;:!?", 10, 11, 12, 13]] = True
PARTS_WORDS = ENDS_PIECE.copy()
PARTS_WORDS[[9, 32]] = True
#: Bits of a rank, of a tile's side, and the pairs from which on a tile is dense.
RANK_BITS, TILE_BITS, DENSE = 20, 9, 1 << 15
#: Bytes of text that are cut into words at once, and pairs that are counted at once.
PIECE = 1 << 20
PAIRS_AT_ONCE = 1 << 19
#: Stands for a word or pair that isn't frequent.
NONE = np.int64(1 << 62)


def _tied(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two, with its top bit set."""
    return tv.mix(tv.mix(first) * _U(0x9E3779B97F4A7C15) + second) | _TOP


@dataclass
class Phrased:
    """The words of a piece: 64-bit hashes with their row's language, their spans, and whether the next word follows in one piece of the text."""

    hashes: np.ndarray
    words: tv.Words
    follows: np.ndarray
    lang: np.ndarray


def phrased(piece: tv.Piece, lang: np.ndarray, lang_hashes: np.ndarray) -> Phrased:
    """lang is the place of each row's language among lang_hashes."""
    w = tv.words(piece, PARTS_WORDS)
    of_word = np.repeat(lang[piece.lo : piece.hi], w.counts)
    h = _tied(lang_hashes[of_word], tv.span_hashes(piece.data, w.starts, w.ends, tv.LOWER_VALUES)) if len(w.starts) else np.zeros(0, np.uint64)
    ends = np.concatenate([[0], np.cumsum(ENDS_PIECE[piece.data])])
    follows = ends[w.ends[:-1]] == ends[w.starts[1:]]
    last = w.bounds[1:-1]
    follows[last[(last > 0) & (last < len(w.starts))] - 1] = False
    return Phrased(h, w, follows, of_word)


def _rows(batches):
    """(language texts, Phrased, piece) of all pieces of (lang, text) batches, and None after each batch."""
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        texts = names.dictionary
        joined = next(tv.pieces(texts, 1 << 62), None)
        hashes = tv.span_hashes(joined.data, joined.bounds[:-1], joined.bounds[1:]) if joined else np.zeros(0, np.uint64)
        lang = np.asarray(names.indices)
        for piece in tv.pieces(batch.column(1), PIECE):
            yield texts, phrased(piece, lang, hashes), piece
        yield texts, None, None


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of bytes as texts, A-Z lower-cased."""
    n = ends - starts
    at = np.concatenate([[0], np.cumsum(n)])
    raw = tv.LOWER_BYTES[data[np.repeat(starts - at[:-1], n) + np.arange(at[-1])]]
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw))


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, id (its hash) and n of each word of rows(lang, text)."""

    def run(batches):
        ids, counts, langs, words = [], [], [], []
        for texts, p, piece in _rows(batches):
            if p is not None:
                own, first, n = np.unique(p.hashes, return_index=True, return_counts=True)
                ids.append(own)
                counts.append(n)
                langs.append(p.lang[first])
                words.append(_gathered(piece.data, p.words.starts[first], p.words.ends[first]))
            elif ids:
                flat = np.concatenate(ids)
                own, first, back = np.unique(flat, return_index=True, return_inverse=True)
                n = np.bincount(back, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)
                lang = texts.take(pa.array(np.concatenate(langs)[first]))
                word = pa.concat_arrays(words).take(pa.array(first)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang, word, pa.array(own.view(np.int64)), pa.array(n)], ["lang", "word", "id", "n"])
                ids, counts, langs, words = [], [], [], []

    return rows.mapInArrow(run, "lang string, word string, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


@dataclass
class Ranks:
    """The frequent ids: `names` of the head in ascending order with their ranks, and bits of all others."""

    names: np.ndarray
    rank: np.ndarray
    bits: np.ndarray
    bit_bits: int
    _shift: int = field(init=False)
    _start: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        buckets = max(1, len(self.names)).bit_length()
        self._shift = 63 - buckets  # the top bit of all names is set
        self._start = np.searchsorted((self.names & ~_TOP) >> _U(self._shift), np.arange((1 << buckets) + 1, dtype=np.uint64)).astype(np.int32)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each hash, the hash itself where it is beyond the head, NONE where it isn't frequent."""
        out = np.full(len(hashes), NONE)
        bucket = ((hashes & ~_TOP) >> _U(self._shift)).astype(np.int64)
        at, end = self._start[bucket], self._start[bucket + 1]
        active = np.flatnonzero(at < end)
        while len(active):
            here = at[active]
            hit = self.names[here] == hashes[active]
            out[active[hit]] = self.rank[here[hit]]
            active = active[~hit]
            at[active] += 1
            active = active[at[active] < end[active]]
        if len(self.bits):
            rest = np.flatnonzero(out == NONE)
            place = (tv.mix(hashes[rest]) >> _U(64 - self.bit_bits)).astype(np.int64)
            some = rest[(self.bits[place >> 6] >> (place & 63).astype(np.uint64)) & _U(1) == 1]
            out[some] = hashes[some].view(np.int64)
        return out

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        out = ids.view(np.uint64).copy()
        head = np.flatnonzero(ids >= 0)
        by_rank = np.empty_like(self.names)
        by_rank[self.rank] = self.names
        out[head] = by_rank[ids[head]]
        return out


def ranks(frequent: DataFrame, most_ranks: int, bit_bits: int) -> Ranks:
    """The ranks by n of frequent(id, n): at most most_ranks of them, and 2**bit_bits bits for what is beyond.

    The head ends between two classes of counts (a sixteenth of a doubling each), so no sort is needed to find it.
    """
    grade = F.floor(F.log2("n") * 16).cast("int")
    classes = frequent.groupBy(grade.alias("c")).agg(F.count("*").alias("k")).orderBy(F.desc("c")).collect()  # at most 16 * 63 rows
    least, taken = None, 0
    for r in classes:
        if taken + r["k"] > most_ranks:
            break
        least, taken = r["c"], taken + r["k"]
    in_head = grade >= least if least is not None else F.lit(False)
    head = frequent.where(in_head).select("id", "n").toArrow()
    names, n = head.column("id").to_numpy().astype(np.int64).view(np.uint64), head.column("n").to_numpy()
    order = np.argsort(names)
    names, n = names[order], n[order]
    rank = np.empty(len(names), dtype=np.int32)
    rank[np.lexsort((names, -n))] = np.arange(len(names))
    bits = np.zeros(0, dtype=np.uint64)
    if taken < sum(r["k"] for r in classes):

        def places(batches):
            for batch in batches:
                place = (tv.mix(batch.column(0).to_numpy().view(np.uint64)) >> _U(64 - bit_bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array((_U(1) << (place & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])

        rows = frequent.where(~in_head).select("id").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
        bits = np.zeros(1 << (bit_bits - 6), dtype=np.uint64)
        bits[rows.column("word").to_numpy()] = rows.column("bit").to_numpy().astype(np.int64).view(np.uint64)
    return Ranks(names, rank, bits, bit_bits)


def tile_counts(x: np.ndarray, y: np.ndarray, dense: int = DENSE, tiles_at_once: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (x, y) of ids and how often each occurs.

    Pairs of ranks are counted by tile, others (with a hash, which is negative) as sorted coordinates.
    """
    out = []
    ranked = (x >= 0) & (y >= 0)
    a, b = x[ranked], y[ranked]
    side = RANK_BITS - TILE_BITS
    tile = ((a >> TILE_BITS) << side) | (b >> TILE_BITS)
    often = np.bincount(tile, minlength=1)
    full = np.flatnonzero(often >= dense)
    sparse = np.ones(len(tile), dtype=bool)
    low = (1 << TILE_BITS) - 1
    cells = 1 << (2 * TILE_BITS)
    for lo in range(0, len(full), tiles_at_once):
        some = full[lo : lo + tiles_at_once]
        number = np.full(len(often), -1, dtype=np.int32)
        number[some] = np.arange(len(some))
        at = np.flatnonzero(number[tile] >= 0)
        sparse[at] = False
        n = np.bincount(number[tile[at]].astype(np.int64) * cells + ((a[at] & low) << TILE_BITS) + (b[at] & low), minlength=1)
        cell = np.flatnonzero(n)
        t = some[cell // cells]
        cell_a, cell_b = (cell % cells) >> TILE_BITS, cell & low
        out.append((((t >> side) << TILE_BITS) + cell_a, ((t & ((1 << side) - 1)) << TILE_BITS) + cell_b, n[cell]))
    code, n = np.unique((a[sparse] << RANK_BITS) | b[sparse], return_counts=True)
    out.append((code >> RANK_BITS, code & ((1 << RANK_BITS) - 1), n))
    a, b = x[~ranked], y[~ranked]
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        out.append((a[at], b[at], np.diff(np.append(at, len(a)))))
    return tuple(np.concatenate([o[i] for o in out]).astype(np.int64) for i in range(3))


def _counted(rows: DataFrame, find, least: int) -> DataFrame:
    """x, y, n of the pairs that find(Phrased) gives, summed over all tasks, of those that occur `least` times."""

    def run(batches):
        xs, ys, held = [], [], 0
        for _, p, _ in _rows(batches):
            if p is not None:
                x, y = find(p)
                xs.append(x)
                ys.append(y)
                held += len(x)
            if held >= PAIRS_AT_ONCE or (p is None and held):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in tile_counts(np.concatenate(xs), np.concatenate(ys))], ["x", "y", "n"])
                xs, ys, held = [], [], 0

    return rows.mapInArrow(run, "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent_pairs(rows: DataFrame, words: Ranks, least: int) -> DataFrame:
    """id (its hash), a, b (of its words) and n of each pair of words in a row that occurs at least `least` times."""
    held = rows.sparkSession.sparkContext.broadcast(words)

    def find(p: Phrased):
        ids = held.value.ids(p.hashes)
        ok = p.follows & (ids[:-1] != NONE) & (ids[1:] != NONE)
        return ids[:-1][ok], ids[1:][ok]

    def named(batches):
        for batch in batches:
            a, b = (held.value.hashes(batch.column(c).to_numpy()) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_tied(a, b).view(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column(2)], ["id", "a", "b", "n"])

    return _counted(rows, find, least).mapInArrow(named, "id long, a long, b long, n long")


def frequent_triples(rows: DataFrame, words: Ranks, pairs: Ranks, least: int) -> DataFrame:
    """pair (the hash of the first two words), c (of the third) and n of each three words in a row that occur at least `least` times."""
    held = rows.sparkSession.sparkContext.broadcast((words, pairs))

    def find(p: Phrased):
        words, pairs = held.value
        at = np.flatnonzero(p.follows)
        of_pair = np.full(len(p.follows), NONE)
        of_pair[at] = pairs.ids(_tied(p.hashes[at], p.hashes[at + 1]))
        both = np.flatnonzero((of_pair[:-1] != NONE) & (of_pair[1:] != NONE))
        third = words.ids(p.hashes[both + 2])
        known = third != NONE  # a pair's bit may be set by chance
        return of_pair[both[known]], third[known]

    def named(batches):
        words, pairs = held.value
        for batch in batches:
            x, y = (r.hashes(batch.column(c).to_numpy()).view(np.int64) for c, r in ((0, pairs), (1, words)))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), batch.column(2)], ["pair", "c", "n"])

    return _counted(rows, find, least).mapInArrow(named, "pair long, c long, n long")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"({wide(a)} * {wide(a)} * 1000000) div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, least: int = 10, most: int = 2000, inside_percent: int = 50, most_ranks: int = 1 << RANK_BITS, bit_bits: int = 25) -> DataFrame:
    """The first phrases of two and three words of each language: lang, rank, phrase, a, l, r, n and score.

    Pieces, words, candidates, scores and the phrases dropped for a longer one are those of op13's
    contract: a is the phrase's count, l and r those of the two sides of its weakest cut, n the
    words of the language. Null and empty texts have no words, texts of any length are read whole,
    repeated rows all count, a null language is `und`, and an empty table gives no rows. Columns
    other than text and lang don't matter. Broadcast are at most most_ranks words and pairs with
    their ranks (16 bytes each) and 2**bit_bits bits for the others.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counted = cut(word_counts(rows))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    words = cut(counted.where(F.col("n") >= least))
    by_word = ranks(words, most_ranks, bit_bits)
    pairs = cut(frequent_pairs(rows, by_word, least))
    triples = cut(frequent_triples(rows, by_word, ranks(pairs, most_ranks, bit_bits), least))

    word = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"), F.col("n").alias(f"{c}_n"))
    first = words.select(F.col("id").alias("a"), "lang", F.col("word").alias("a_word"), F.col("n").alias("a_n"))
    second = pairs.select(F.col("id").alias("bc"), F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("bc_n"))
    threes = triples.join(pairs.select(F.col("id").alias("pair"), "a", "b", F.col("n").alias("ab_n")), "pair").join(second, ["b", "c"])
    threes = cut(threes.select(F.col("pair").alias("ab"), "bc", "a", "b", "c", "n", "ab_n", "bc_n"))
    inside = threes.select(F.explode(F.array("ab", "bc")).alias("id"), "n").groupBy("id").agg(F.max("n").alias("longer"))
    kept = pairs.join(inside, "id", "left").where(F.expr(f"longer is null or 100 * longer < {int(inside_percent)} * n"))
    twos = kept.select("a", "b", "n").join(first, "a").join(word("b"), "b")
    twos = twos.select("lang", F.concat_ws(" ", "a_word", "b_word").alias("phrase"), "n", F.col("a_n").alias("l"), F.col("b_n").alias("r"), _score("n", "a_n", "b_n").alias("score"))
    threes = threes.join(first, "a").join(word("b"), "b").join(word("c"), "c").withColumns({"s1": _score("n", "a_n", "bc_n"), "s2": _score("n", "ab_n", "c_n")})
    early = F.col("s1") <= F.col("s2")
    threes = threes.select("lang", F.concat_ws(" ", "a_word", "b_word", "c_word").alias("phrase"), "n", F.when(early, F.col("a_n")).otherwise(F.col("ab_n")).alias("l"), F.when(early, F.col("bc_n")).otherwise(F.col("c_n")).alias("r"), F.least("s1", "s2").alias("score"))
    found = twos.union(threes).withColumnRenamed("n", "a")
    place = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    # a language's candidates are thinned out before they meet
    thin = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", place("salt")).where(F.col("rank") <= most)
    ranked = thin.withColumn("rank", place().cast("long")).where(F.col("rank") <= most)
    return ranked.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
