"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK random walk reads a word sequence with a pointer: step t emits the word under the
pointer and moves on by a random bit that depends on t and the word alone. Two sequences of
small edit distance so get embeddings of small Hamming distance, because after an edit the walks
tend to meet again. A repetition samples some steps of one walk; sequences whose sampled words
are all equal meet in one table entry.

Every benchmark item is covered by windows of `window` words, one from each of its words, and a
window starts at every word of every document. So an item-sized passage gets as many chances to
be found as it has windows, times the repetitions; a hit names the alignment of the whole item,
and the item-sized passage there is verified by its exact edit distance, counted in words.

Items too short for a walk that samples three words are looked up without walks, by words that
their edits must leave alone: a key of one common word would make every item that has it a
candidate wherever it stands.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import documents

_U = np.uint64
#: Window sizes; an item uses the largest that finds it with at most FEW_WALKS walks.
WINDOWS = (10, 5)
FEW_WALKS = 16
#: Items of more words than this are found at least as often as those of this many.
LONG_ITEM = 40


def repetitions(recall: float, kept_words: float, samples: int) -> int:
    """Walks needed so that one window is found with the recall wanted.

    kept_words is the chance that a sampled step shows the same word in both walks.
    """
    one = kept_words**samples
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))


class Walks:
    """The random walks and sampled steps of one window size."""

    def __init__(self, window: int, count: int, seed: int = 17) -> None:
        # a walk doesn't depend on how many there are
        each = [np.random.default_rng([seed, window, r]) for r in range(count)]
        self.window = window
        size = max(1, (window + 1) // 2)
        self.seeds = np.array([rng.integers(0, 2**63, dtype=np.uint64) for rng in each])
        self.samples = [np.sort(rng.choice(window, size, replace=False)) for rng in each]

    def keys(self, h: np.ndarray, starts: np.ndarray, which: int) -> np.ndarray:
        """The sampled words of walk `which` from each start, as one 64-bit key.

        A walk of `window` steps never leaves its window. The bit of step t is bit t of the
        word's hash under the walk's seed.
        """
        bits = tv.mix(h ^ self.seeds[which])
        pos = starts.astype(np.int32)
        key = np.zeros(len(starts), dtype=np.uint64)
        steps = self.samples[which]
        for t in range(int(steps[-1]) + 1):
            if t in steps:
                key *= _U(0x9E3779B97F4A7C15)
                key += h[pos]
            if t < steps[-1]:
                pos += ((bits[pos] >> _U(t)) & _U(1)).astype(np.int32)
        return tv.mix(key)


def _edited(items: np.ndarray, edits: int, kind: str, rng: np.random.Generator) -> np.ndarray:
    """Each row with words replaced, inserted or deleted at random places, and random words around."""
    new = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    rows = []
    n = items.shape[1]
    for item in items:
        at = rng.choice(n, edits, replace=False)
        if kind == "replace":
            item = item.copy()
            item[at] = new(edits)
        elif kind == "insert":
            item = np.insert(item, at, new(edits))
        else:
            item = np.delete(item, at)
        rows.append(np.concatenate([new(10), item, new(10)]))
    return np.stack(rows)


@lru_cache(maxsize=1024)
def walks_needed(n: int, size: int, edits: int, recall: float, trials: int = 400) -> int:
    """Walks that find passages with `edits` edits to items of n words with the recall wanted; 0 if over FEW_WALKS.

    Told by trial with the very walks that are used; of each kind of edit the share has to be reached.
    """
    if not edits:
        return 1
    rng = np.random.default_rng([5, n, size, edits])
    walks, most = Walks(size, FEW_WALKS), 1
    grid = lambda a: (a.ravel(), (np.arange(len(a))[:, None] * a.shape[1] + np.arange(a.shape[1] - size + 1)).ravel(), a.shape[1] - size + 1)
    for kind in ("replace", "insert", "delete"):
        items = rng.integers(0, 2**63, (trials, n), dtype=np.uint64)
        a, b = grid(items), grid(_edited(items, edits, kind, rng))
        found = np.zeros(trials, dtype=bool)
        for r in range(FEW_WALKS):
            ka, kb = (walks.keys(h, starts, r) for h, starts, _ in (a, b))
            found[np.flatnonzero(np.isin(ka, kb)) // a[2]] = True
            if found.mean() >= recall + 0.01:
                break
        else:
            return 0
        most = max(most, r + 1)
    return most


@lru_cache(maxsize=1024)
def window_and_walks(n: int, recall: float, kept_words: float, max_edits: float) -> tuple[int, int]:
    """The window size and the number of walks for items of n words; (0, 0) where no size will do."""
    m = min(n, LONG_ITEM)
    for size in (w for w in WINDOWS if w <= n):
        count = walks_needed(m, size, int(max_edits * m), recall)
        if count:
            break
    else:
        return 0, 0
    return size, max(count, repetitions(recall, kept_words, (size + 1) // 2))


class Lookup:
    """Sorted keys of places in items, found by equal keys of places in texts."""

    BITS = 20

    def __init__(self, keys: np.ndarray, order: np.ndarray) -> None:
        sort = np.argsort(keys, kind="stable")
        self.keys, self.order = keys[sort], order[sort]
        self.seen = np.zeros(1 << self.BITS, dtype=bool)
        self.seen[(keys >> _U(64 - self.BITS)).astype(np.int64)] = True

    def equal(self, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in mine, the item place's number) of all equal keys."""
        some = np.flatnonzero(self.seen[(mine >> _U(64 - self.BITS)).astype(np.int64)])
        lo, hi = (np.searchsorted(self.keys, mine[some], side=s) for s in ("left", "right"))
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(some, n), self.order[at]


class Table:
    """The windows of some items, each under as many of the walks as it needs, looked up by key."""

    def __init__(self, walks: Walks, hashes: list[np.ndarray], items: list[int], counts: list[int]) -> None:
        self.walks = walks
        flat = np.concatenate(hashes)
        begin = np.cumsum([0, *map(len, hashes)])
        item, offset = [], []
        for i, h in zip(items, hashes, strict=True):
            n = len(h) - walks.window + 1
            item.append(np.full(n, i))
            offset.append(np.arange(n))
        starts = np.concatenate([o + b for o, b in zip(offset, begin[:-1], strict=True)])
        self.item, self.offset = np.concatenate(item), np.concatenate(offset)
        needed = np.repeat(counts, [len(o) for o in offset])
        self.lookups = []
        for r in range(len(walks.seeds)):
            some = np.flatnonzero(needed > r)
            self.lookups.append(Lookup(walks.keys(flat, starts[some], r), some))

    def hits(self, h: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word of the text, index of item window) of all equal keys; left has the words from each one to its text's end."""
        starts = np.flatnonzero(left >= self.walks.window)
        out = [lookup.equal(self.walks.keys(h, starts, r)) for r, lookup in enumerate(self.lookups)]
        return starts[np.concatenate([a for a, _ in out])], np.concatenate([b for _, b in out])


def stretches(n: int, edits: int) -> list[tuple[int, int, int]]:
    """(begin, words, edits) of stretches of an item of n words: however its edits fall, one of them has at most its own, 0 or 1.

    Stretches of four words with one edit come first, as they need the fewest words for the edits
    that they take; where an item is too short for these it is cut evenly, each part without an edit.
    """
    out, at, left = [], 0, edits + 1
    while left > 1 and at + 4 <= n:
        out.append((at, 4, 1))
        at, left = at + 4, left - 2
    if left == 1 and n - at >= min(3, n):
        out.append((at, n - at, 0))
        left = 0
    if left <= 0:
        return out
    size = max(1, n // (edits + 1))
    return [(k, size, 0) for k in range(0, size * min(n, edits + 1), size)]


class ShortTable:
    """Short items under words that their edits must leave alone.

    Four words with an edit keep three of them in order: side by side, or with one strange word
    among them. Each such triple is a key for the steps at which a text may show it.
    """

    #: Of four words the three that an edit leaves, and how they may then stand in a text.
    KEPT = {(0, 1, 2): [(0, 1, 2), (0, 1, 3)], (1, 2, 3): [(0, 1, 2)], (0, 2, 3): [(0, 1, 2), (0, 2, 3)], (0, 1, 3): [(0, 1, 2), (0, 1, 3)]}

    def __init__(self, hashes: list[np.ndarray], items: list[int], edits: list[int]) -> None:
        flat = np.concatenate(hashes)
        begin = np.cumsum([0, *map(len, hashes)])
        # for each way to stand in a text: the words kept of a stretch, its first word in flat, item, offset
        rows: dict[tuple[int, ...], list[tuple[tuple[int, ...], int, int, int]]] = {}
        for i, h, first, e in zip(items, hashes, begin.tolist(), edits, strict=False):
            for at, size, own in stretches(len(h), e):
                plain = tuple(range(size))
                for kept, ways in self.KEPT.items() if own else [(plain, [plain])]:
                    for way in ways:
                        rows.setdefault(way, []).append((kept, first + at, i, at + kept[0]))
        item, offset, self.lookups, count = [], [], [], 0
        for way, places_ in rows.items():
            at = np.array([[p + k for k in kept] for kept, p, _, _ in places_])
            self.lookups.append((way, Lookup(self._keys(flat, at), np.arange(count, count + len(at)))))
            item += [i for _, _, i, _ in places_]
            offset += [o for *_, o in places_]
            count += len(at)
        self.item, self.offset = np.array(item), np.array(offset)

    @staticmethod
    def _keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = np.zeros(len(at), dtype=np.uint64)
        for column in at.T:
            key *= _U(0x9E3779B97F4A7C15)
            key += h[column]
        return tv.mix(key)

    def hits(self, h: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word of the text, index of item place) of all equal keys."""
        mine, theirs = [], []
        for way, lookup in self.lookups:
            starts = np.flatnonzero(left > way[-1])
            a, b = lookup.equal(self._keys(h, starts[:, None] + np.array(way)))
            mine.append(starts[a])
            theirs.append(b)
        return np.concatenate(mine), np.concatenate(theirs)


def edit_distance_in(at: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """The least edit distance of a pattern to any stretch of text, and where the first best ends.

    The pattern is given by `at`: for each symbol a bit set of its places among m. Myers' bit
    vectors: bit i stands for row i of the distance matrix.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, symbol in enumerate(text):
        eq = at.get(symbol, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        mh <<= 1
        pv = (mh | (full & ~(xv | ph))) & full
        mv = ph & xv & full
        if score < best:
            best, end = score, j + 1
    return best, end


def places(symbols: list[int]) -> dict[int, int]:
    """For each symbol the bit set of its places."""
    at: dict[int, int] = {}
    for i, symbol in enumerate(symbols):
        at[symbol] = at.get(symbol, 0) | 1 << i
    return at


class Index:
    """A block of benchmark items, ready to be looked for in documents."""

    def __init__(self, items: list[tuple[int, str]], recall: float, kept_words: float, max_edits: float) -> None:
        self.max_edits = max_edits
        self.ids, self.places, self.words, hashes = [], [], [], []
        for i, text in items:
            piece = next(tv.pieces(pa.array([text])))
            w = tv.words(piece)
            if len(w.starts):
                self.ids.append(i)
                self.words.append(len(w.starts))
                hashes.append(tv.span_hashes(piece.data, w.starts, w.ends, tv.LOWER_VALUES))
                self.places.append(places(hashes[-1].tolist()))
        self.tables = []
        plan = [window_and_walks(len(h), recall, kept_words, max_edits) for h in hashes]
        for size in WINDOWS:
            fit = [i for i, (window, _) in enumerate(plan) if window == size]
            if fit:
                counts = [plan[i][1] for i in fit]
                self.tables.append(Table(Walks(size, max(counts)), [hashes[i] for i in fit], fit, counts))
        short = [i for i, (window, _) in enumerate(plan) if not window]
        if short:
            self.tables.append(ShortTable([hashes[i] for i in short], short, [int(max_edits * self.words[i]) for i in short]))

    def search(self, piece: tv.Piece):
        """(row, item number, first word, words, edits) of each passage found in a piece."""
        w = tv.words(piece)
        if not len(w.starts):
            return []
        h = tv.span_hashes(piece.data, w.starts, w.ends, tv.LOWER_VALUES)
        rows = w.rows()
        left = w.bounds[1:][rows] - np.arange(len(rows))
        found = []
        for table in self.tables:
            a, b = table.hits(h, left)
            if not len(a):
                continue
            place, item = a - table.offset[b], table.item[b]
            row = rows[a]
            # nearly the same alignments of an item with a row are verified once
            seen = np.unique(np.stack([row, item, place // 4]), axis=1, return_index=True)[1]
            for k in seen.tolist():
                found.append((int(row[k]), int(item[k]), int(place[k])))
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, place in sorted(found):
            if out.get((row, item), (1,))[0] == 0:
                continue
            n = self.words[item]
            most = int(self.max_edits * n)
            begin = int(w.bounds[row])
            lo = max(begin, place - most - 4)
            region = h[lo : min(int(w.bounds[row + 1]), place + n + most + 4)].tolist()
            at = self.places[item]
            # each item word that the region hasn't got costs an edit
            if sum(symbol in at for symbol in region) < n - most:
                continue
            edits, end = edit_distance_in(at, n, region)
            if edits <= most and edits < out.get((row, item), (n + 1,))[0]:
                out[row, item] = (edits, max(lo + end - n - begin, 0), n)
        return [(row, item, first, n, edits) for (row, item), (edits, first, n) in sorted(out.items())]


SCHEMA = "doc_id long, item_id long, first_word long, n_words long, edits long"


def _blocks(benchmark: DataFrame, recall: float, kept_words: float, max_edits: float, block_chars: int, item_col: str, text_col: str):
    """Broadcast indexes of the benchmark's items, block by block."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_chars))
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = block.orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in rows], recall, kept_words, max_edits))


def benchmark_passages(docs: DataFrame, benchmark: DataFrame, recall: float = 0.95, kept_words: float = 0.9, max_edits: float = 0.3, block_chars: int = 16 << 20, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The passages of benchmark items in documents: doc_id, item_id, place and edits.

    A passage counts if some stretch of the document's words can be made the item's words by at
    most max_edits times their number of insertions, deletions and replacements of words; A-Z
    is read as a-z. Items are
    taken to the tasks in blocks of at most block_chars characters (one longer item is a block
    of its own), and each block is looked for in all documents. Null and wordless texts match
    nothing; a null doc_id is carried along; repeated rows are reported alike. Texts of any length
    are searched whole. Without documents or items nothing is found; further columns are not read.
    """
    narrow = documents(docs)
    out = None
    for held in _blocks(benchmark, recall, kept_words, max_edits, block_chars, item_col, text_col):

        def run(batches, held=held):
            index = held.value
            for batch in batches:
                ids = batch.column(0)
                for piece in tv.pieces(batch.column(1)):
                    rows = index.search(piece)
                    if rows:
                        row, item, first, n, edits = (list(c) for c in zip(*rows, strict=True))
                        found = ids.slice(piece.lo, piece.n).take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([found, pa.array([index.ids[i] for i in item], pa.int64()), *(pa.array(c, pa.int64()) for c in (first, n, edits))], names=[c.split()[0] for c in SCHEMA.split(", ")])

        part = narrow.mapInArrow(run, SCHEMA)
        out = part if out is None else out.union(part)
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, recall: float = 0.95, kept_words: float = 0.9, max_edits: float = 0.3, block_chars: int = 16 << 20) -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns.

    What counts as a passage is as in `benchmark_passages`. Null, empty and wordless texts stay, as
    do null ids; repeated rows stay or go alike; texts of any length are searched whole. Of an empty
    table nothing is left, and without items all documents are. Further columns are carried along
    under their names.
    """
    for held in _blocks(benchmark, recall, kept_words, max_edits, block_chars, "item_id", "text"):

        def run(batches, held=held):
            index = held.value
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for piece in tv.pieces(batch.column("text")):
                    for row, *_ in index.search(piece):
                        clean[piece.lo + row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
