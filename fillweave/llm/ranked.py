"""Ranked lexical search: a K2-treap over the grid of terms and documents, descended best-first.

Documents are taken in segments of bounded text, in a task each. A segment's grid has a row for
each term, the most frequent first, and a column for each document in the order of ids; a point is
the impact of a term in a document. The grid is a compressed quadtree: a cell has the largest
impact in it and leads to those of its four quarters that have points; a cell of one point ends
there. An item's terms descend together: a range of documents has for each of the item's rows the
cell that the row crosses it in, and its bound is the sum of weights times these cells' maxima. The
ranges of highest bound are halved first, until no range left can beat the k-th best document that
the task has found so far, in this segment or an earlier one. Bounds are whole numbers, so the
result is exact, ties included.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut, documents

_U = np.uint64
#: Bytes that part terms: ASCII other than digits and letters.
PARTS_TERMS = np.ones(256, dtype=bool)
PARTS_TERMS[128:] = PARTS_TERMS[48:58] = PARTS_TERMS[65:91] = PARTS_TERMS[97:123] = False
#: Stands for a null doc_id, which so comes after all others.
NO_ID = np.iinfo(np.int64).max


def terms(piece: tv.Piece) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of a piece's terms, A-Z lower-cased, and how many each row has."""
    w = tv.words(piece, PARTS_TERMS)
    return tv.span_hashes(piece.data, w.starts, w.ends, tv.LOWER_VALUES), w.counts


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2**31 on the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << _U(shift))) & _U(mask)
    return x


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted keys."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


class Treap:
    """The quadtree of points (row, column, value): cells level by level, each with its maximum.

    `kinds` has a bit for each quarter that has points (bit 2 * row half + column half), 0 for a
    cell of one point, whose place is in `row` and `col`; `first` is the first quarter's cell.
    Rows are moved up to as many bits as columns have, so that cells are narrow in rows early.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, rows: int, cols: int) -> None:
        bits = lambda n: max(1, int(n - 1).bit_length())
        self.depth = max(bits(rows), bits(cols))
        self.shift = self.depth - bits(rows)
        code = (_spread(row << self.shift) << _U(1)) | _spread(col)
        order = np.argsort(code)
        code, row, col, value = code[order], row[order], col[order], value[order]
        largest, kinds, first, at_row, at_col, done = [], [], [], [], [], 0
        for level in range(self.depth + 1):
            if not len(code):
                break
            start = _starts(code >> _U(2 * (self.depth - level)))
            counts = np.diff(np.append(start, len(code)))
            single = counts == 1
            largest.append(np.maximum.reduceat(value, start))
            at_row.append(np.where(single, row[start], 0))
            at_col.append(np.where(single, col[start], 0))
            below = np.repeat(~single, counts)
            code, row, col, value = code[below], row[below], col[below], value[below]
            kind = np.zeros(len(start), dtype=np.uint8)
            begin = np.zeros(len(start), dtype=np.int64)
            done += len(start)
            if len(code):
                quarter = code >> _U(2 * (self.depth - level - 1))
                quarter = quarter[_starts(quarter)]
                parent = _starts(quarter >> _U(2))
                kind[~single] = np.add.reduceat((1 << (quarter & _U(3)).astype(np.int64)), parent)
                begin[~single] = done + parent
            kinds.append(kind)
            first.append(begin)
        none = [np.zeros(0, np.int64)]
        self.largest, self.first, self.row, self.col = (np.concatenate(x or none).astype(np.int32) for x in (largest, first, at_row, at_col))
        self.kinds = np.concatenate(kinds or none).astype(np.uint8)

    def below(self, node: np.ndarray, row: np.ndarray, level: np.ndarray, col_half: int) -> np.ndarray:
        """The cells that rows cross in one half of the columns of their cells, -1 for none; level is that of the cells."""
        bit = (((row << self.shift) >> (self.depth - 1 - level)) & 1) * 2 + col_half
        kind = self.kinds[node].astype(np.int64)
        there = (kind >> bit) & 1
        place = self.first[node] + _ONES[kind & ((1 << bit) - 1)]
        out = np.where(there == 1, place, -1)
        alone = kind == 0
        half = (self.col[node] >> (self.depth - 1 - level)) & 1
        out[alone] = np.where(half[alone] == col_half, node[alone], -1)
        # a cell of one point is another row's if that isn't the row asked for
        some = np.flatnonzero(out >= 0)
        other = some[(self.kinds[out[some]] == 0) & (self.row[out[some]] != row[some])]
        out[other] = -1
        return out


_ONES = np.array([bin(i).count("1") for i in range(16)])


class Best:
    """The k best documents of each item so far: score descending, then id."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.score = np.zeros((items, k), dtype=np.int64)
        self.doc = np.full((items, k), NO_ID, dtype=np.int64)

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(item)
        place = np.searchsorted(touched, item)
        old = np.repeat(np.arange(len(touched)), self.k)
        place, doc, score = np.concatenate([old, place]), np.concatenate([self.doc[touched].ravel(), doc]), np.concatenate([self.score[touched].ravel(), score])
        order = np.lexsort((doc, -score, place))
        place = place[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        top = order[rank < self.k]
        self.doc[touched], self.score[touched] = doc[top].reshape(-1, self.k), score[top].reshape(-1, self.k)

    def open(self, item: np.ndarray, bound: np.ndarray, least_doc: np.ndarray) -> np.ndarray:
        """Which ranges may hold a document that gets in."""
        last = self.score[item, -1]
        return (bound > last) | ((bound == last) & (bound > 0) & (least_doc < self.doc[item, -1]))


def _pool(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def descend(treap: Treap, ids: np.ndarray, item: np.ndarray, row: np.ndarray, weight: np.ndarray, best: Best, at_once: int = 64) -> None:
    """Find the documents of a segment that are among the best of their items.

    item, row and weight are the items' terms that the segment has, sorted by item. ids are the
    columns' documents in ascending order. In each step every item halves its at_once ranges of
    highest bound.
    """
    if not len(item) or not len(treap.kinds):
        return
    start = _starts(item)
    node = np.zeros(len(item), dtype=np.int64)
    if treap.kinds[0] == 0:
        node[treap.row[0] != row] = -1
        keep = node >= 0
        item, row, weight, node = item[keep], row[keep], weight[keep], node[keep]
        if not len(item):
            return
        start = _starts(item)
    # ranges, and for each its terms' rows, weights and cells in the same order
    r_item, r_level, r_col = item[start], np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    r_bound = np.add.reduceat(weight * treap.largest[node], start)
    r_n = np.diff(np.append(start, len(item)))
    p_row, p_weight, p_node = row, weight, node
    while len(r_item):
        order = np.lexsort((r_col, -r_bound, r_item))
        rank = np.arange(len(order)) - np.searchsorted(r_item[order], r_item[order])
        chosen = np.zeros(len(order), dtype=bool)
        chosen[order[rank < at_once]] = True
        of_path = np.repeat(chosen, r_n)
        row, weight, node = p_row[of_path], p_weight[of_path], p_node[of_path]
        owner = np.repeat(np.arange(int(chosen.sum())), r_n[chosen])
        item, level, col = r_item[chosen], r_level[chosen], r_col[chosen]
        left = ~chosen
        r_item, r_level, r_col, r_bound, r_n = r_item[left], r_level[left], r_col[left], r_bound[left], r_n[left]
        p_row, p_weight, p_node = p_row[~of_path], p_weight[~of_path], p_node[~of_path]

        # where only cells of one point are left, their documents are known
        ends = np.logical_and.reduceat(treap.kinds[node] == 0, _starts(owner)) if len(owner) else np.zeros(0, bool)
        known = ends[owner]
        if known.any():
            doc = treap.col[node[known]].astype(np.int64)
            key = item[owner[known]] * len(ids) + doc
            sort = np.argsort(key, kind="stable")
            at = _starts(key[sort])
            score = np.add.reduceat((weight[known] * treap.largest[node[known]])[sort], at)
            found = key[sort][at]
            best.add(found // len(ids), ids[found % len(ids)], score)
            row, weight, node, owner = row[~known], weight[~known], node[~known], owner[~known]
        parts = []
        for half in (0, 1):
            to = treap.below(node, row, level[owner], half)
            there = np.flatnonzero(to >= 0)
            parts.append((2 * owner[there] + half, row[there], weight[there], to[there]))
        key, row, weight, node = (_pool([p[i] for p in parts]) for i in range(4))
        sort = np.argsort(key, kind="stable")
        key, row, weight, node = key[sort], row[sort], weight[sort], node[sort]
        start = _starts(key)
        if len(start):
            parent, half = key[start] // 2, key[start] % 2
            new_level = level[parent] + 1
            new_col = col[parent] + (half << (treap.depth - new_level))
            bound = np.add.reduceat(weight * treap.largest[node], start)
            r_item, r_level, r_col = np.concatenate([r_item, item[parent]]), np.concatenate([r_level, new_level]), np.concatenate([r_col, new_col])
            r_bound, r_n = np.concatenate([r_bound, bound]), np.concatenate([r_n, np.diff(np.append(start, len(key)))])
            p_row, p_weight, p_node = np.concatenate([p_row, row]), np.concatenate([p_weight, weight]), np.concatenate([p_node, node])
        stay = best.open(r_item, r_bound, ids[np.minimum(r_col, len(ids) - 1)])
        if not stay.all():
            of_path = np.repeat(stay, r_n)
            r_item, r_level, r_col, r_bound, r_n = r_item[stay], r_level[stay], r_col[stay], r_bound[stay], r_n[stay]
            p_row, p_weight, p_node = p_row[of_path], p_weight[of_path], p_node[of_path]


class Segment:
    """Some documents' terms and treap, given the table's number of documents and of terms."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int) -> None:
        by_id = np.argsort(ids, kind="stable")
        column = np.empty(len(ids), dtype=np.int64)
        column[by_id] = np.arange(len(ids))
        self.ids = ids[by_id]
        self.terms, term = np.unique(hashes, return_inverse=True)
        key, tf = np.unique(term.astype(np.int64) * len(ids) + np.repeat(column, counts), return_counts=True)
        term, col = key // len(ids), key % len(ids)
        held = np.bincount(term, minlength=len(self.terms))
        self.rows = np.empty(len(self.terms), dtype=np.int64)
        self.rows[np.argsort(-held, kind="stable")] = np.arange(len(self.terms))
        m = 75 + (25 * counts[by_id].astype(np.int64) * n_docs) // max(n_terms, 1)
        self.treap = Treap(self.rows[term], col, (1_000_000_000 * tf) // (1000 * tf + 12 * m[col]), len(self.terms), len(ids))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The rows of terms, -1 for those that the segment hasn't got."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, self.rows[at], -1)


def segments(batches, n_docs: int, n_terms: int, segment_bytes: int, most_docs: int = 1 << 16):
    """Segments of the documents (doc_id, text) of a task."""
    ids, hashes, counts, size, rows = [], [], [], 0, 0
    for batch in batches:
        own = np.asarray(batch.column(0).fill_null(NO_ID))
        for piece in tv.pieces(batch.column(1)):
            h, c = terms(piece)
            ids.append(own[piece.lo : piece.hi])
            hashes.append(h)
            counts.append(c)
            size, rows = size + len(piece.data), rows + piece.n
            if size >= segment_bytes or rows >= most_docs:
                yield Segment(np.concatenate(ids), np.concatenate(hashes), np.concatenate(counts), n_docs, n_terms)
                ids, hashes, counts, size, rows = [], [], [], 0, 0
    if ids:
        yield Segment(np.concatenate(ids), np.concatenate(hashes), np.concatenate(counts), n_docs, n_terms)


def statistics(docs: DataFrame, wanted: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each of the wanted hashes (sorted) how many documents hold it."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        names, n_docs, n_terms, df = held.value, 0, 0, np.zeros(len(held.value), dtype=np.int64)
        for batch in batches:
            for piece in tv.pieces(batch.column(1)):
                h, c = terms(piece)
                n_docs, n_terms = n_docs + int((c > 0).sum()), n_terms + len(h)
                if len(names) and len(h):
                    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                    some = np.flatnonzero(names[at] == h)
                    both = np.unique(at[some] * piece.n + np.repeat(np.arange(piece.n), c)[some])
                    df += np.bincount(both // piece.n, minlength=len(names))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], seen])), pa.array(np.concatenate([[n_docs, n_terms], df[seen]]))], ["place", "n"])

    # as many rows as there are wanted terms
    rows = documents(docs).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    found = {r["place"]: r["n"] for r in rows}
    df = np.array([found.get(i, 0) for i in range(len(wanted))], dtype=np.int64)
    return found.get(-2, 0), found.get(-1, 0), df


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_blocks(items: DataFrame, block_chars: int):
    """The items (item_id, text) that have text, in blocks for the driver; equal rows once."""
    items = cut(items.where("text is not null").distinct())
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_chars))
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield block.orderBy("item_id", "text").collect()


def _block_best(docs: DataFrame, rows: list, k: int, segment_bytes: int, items_at_once: int) -> DataFrame | None:
    """item (its place in rows), doc_id, score: the best documents of each task for each item."""
    item, hashes = [], []
    for piece in tv.pieces(pa.array([r["text"] for r in rows], pa.large_string())) if rows else ():
        h, c = terms(piece)
        hashes.append(h)
        item.append(np.repeat(np.arange(piece.lo, piece.hi), c))
    if not hashes:
        return None
    # an item's repeated term counts as often as it stands there
    wanted, term = np.unique(np.concatenate(hashes), return_inverse=True)
    pairs, often = np.unique(np.concatenate(item) * max(len(wanted), 1) + term, return_counts=True)
    item, term = pairs // max(len(wanted), 1), pairs % max(len(wanted), 1)
    n_docs, n_terms, df = statistics(docs, wanted)
    weight = np.array([term_weight(n_docs, d) for d in df.tolist()], dtype=np.int64)[term] * often
    some = (df[term] > 0) & (weight > 0)
    held = docs.sparkSession.sparkContext.broadcast((wanted, item[some], term[some], weight[some]))
    n_items = len(rows)

    def run(batches):
        wanted, item, term, weight = held.value
        best = Best(n_items, k)
        for segment in segments(batches, n_docs, n_terms, segment_bytes):
            row = segment.find(wanted)[term]
            for lo in range(0, n_items, items_at_once):
                a, b = np.searchsorted(item, [lo, lo + items_at_once])
                here = a + np.flatnonzero(row[a:b] >= 0)
                descend(segment.treap, segment.ids, item[here], row[here], weight[here], best)
        at, place = np.nonzero(best.score)
        doc = best.doc[at, place]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(doc, mask=doc == NO_ID), pa.array(best.score[at, place])], ["item", "doc_id", "score"])

    return documents(docs).mapInArrow(run, "item long, doc_id long, score long")


def best_documents(docs: DataFrame, items: DataFrame, k: int = 20, segment_bytes: int = 16 << 20, items_at_once: int = 64, block_chars: int = 16 << 20, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank, doc_id and score, all above 0.

    Terms, weights and impacts are those of op12's contract: whole numbers, so that results don't
    depend on the order of summing. Equal scores go by ascending doc_id, a null one last. Items are
    searched for in blocks of at most block_chars characters; each block indexes all documents
    anew, in the tasks that read them. A null or empty text (of an item or a document) has no
    terms and appears nowhere, texts of any length are read whole, repeated documents each take a
    rank, equal rows of items are answered once and different texts of one item each. Empty
    tables give no rows, and columns other than the ids and texts don't matter.
    """
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    spark, out = docs.sparkSession, None
    top = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    for rows in _item_blocks(items, block_chars):
        found = _block_best(docs, rows, k, segment_bytes, items_at_once)
        if found is None:
            continue
        # each task gives at most k rows an item; they are thinned out before an item's rows meet
        thin = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("r", top("item", "salt")).where(F.col("r") <= k)
        ranked = thin.withColumn("rank", top("item")).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item long, item_id long")
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # one row for each item of a block
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
