"""Quality: Bradley-Terry scores learned from preference pairs, cut at a quantile.

A document's score is linear in features of its whole text. Of a pair of documents the one of
better label is preferred, with probability the logistic function of the difference of their
scores; so the weights come from logistic loss on feature differences. The cut is the quantile
of the sample's scores that leaves the share of bad labels below it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .bpe import _LETTER, _NUMBER, _SPACE, _classes
from .common import label_part
from .letters import _lower
from .toxicity import training_rows

FEATURES = (
    "log_words", "log_lines", "word_length", "letters", "upper", "digits", "marks", "bars", "shouts", "stops", "commas",
    "mixed_words", "distinct_words", "distinct_triples", "distinct_lines", "line_words", "short_words",
)
_MARKS = np.zeros(0x110000, dtype=bool)
_MARKS[[ord(c) for c in "#*$%&<>@^~=_+{}[]"]] = True


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many different hashes each range has."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=len(n))


def features(piece: tv.Piece) -> np.ndarray:
    """The features of each row, in the order of FEATURES; an empty text has zeros."""
    cp, at = tv.code_points(piece)
    edge = piece.bounds if len(cp) == len(piece.data) else np.searchsorted(at, piece.bounds)
    kind = _classes()[cp]
    count = lambda flags: tv.grouped_sum(flags, edge)
    chars = np.maximum(np.diff(edge) - count(kind == _SPACE), 1)
    letter = kind == _LETTER
    letters = count(letter)
    w = tv.words(piece)
    n = w.counts
    hashes = tv.span_hashes(piece.data, w.starts, w.ends, tv.LOWER_VALUES)
    row = w.rows()
    inner = np.maximum(n - 2, 0)
    triples = np.zeros(0, dtype=np.uint64)
    if len(hashes) > 2:
        triple = tv.mix(hashes[:-2] + tv.mix(hashes[1:-1] + tv.mix(hashes[2:])))
        left = w.bounds[1:][row] - np.arange(len(row))
        triples = triple[left[: len(triple)] > 2]
    # a line ends with a line feed or the text
    breaks = np.flatnonzero(piece.data == 10)
    ends = np.union1d(breaks, piece.bounds[1:])
    starts = np.union1d(breaks + 1, piece.bounds[:-1])
    line = np.searchsorted(starts, w.starts, side="right") - 1
    used = np.unique(line)
    # a line with words isn't empty, so it ends after its start
    stop = ends[np.searchsorted(ends, starts[used], side="right")]
    line_row = np.searchsorted(piece.bounds, starts[used], side="right") - 1
    line_bounds = np.searchsorted(line_row, np.arange(piece.n + 1))
    lines = np.diff(line_bounds)
    line_hash = tv.span_hashes(piece.data, starts[used], stop, tv.LOWER_VALUES)
    size = (w.ends - w.starts).astype(np.float64)
    last = piece.data[w.ends - 1] if len(w.ends) else piece.data[:0]
    plain = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128)
    some, some_lines = np.maximum(n, 1), np.maximum(lines, 1)
    columns = [
        np.log1p(n), np.log1p(lines), tv.grouped_sum(size, w.bounds) / some, letters / chars,
        count(letter & (_lower()[cp] != cp)) / np.maximum(letters, 1), count(kind == _NUMBER) / chars,
        count(_MARKS[cp]) / chars, count(cp == ord("|")) / chars, count(cp == ord("!")) / chars, count(cp == ord(".")) / chars,
        count(cp == ord(",")) / chars, tv.grouped_sum(~plain, w.bounds) / some, _distinct(hashes, w.bounds) / some,
        _distinct(triples, np.concatenate([[0], np.cumsum(inner)])) / np.maximum(inner, 1), _distinct(line_hash, line_bounds) / some_lines,
        np.log1p(n / some_lines), tv.grouped_sum(size <= 3, w.bounds) / some,
    ]
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class Ranking:
    """Weights over standardised features and their squares; where and how steeply to cut."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    steep: float = 1.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -4, 4)
        return np.concatenate([z, z * z], axis=1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.steep * (self.strength(x) - self.cut), -30, 30)))


def fit(x: np.ndarray, label: np.ndarray, bad_share: float, pairs: int = 40_000, ridge: float = 1e-3, rounds: int = 30, seed: int = 5) -> Ranking:
    """Fit the ranking to preference pairs drawn between rows of label 1 and of label 0.

    bad_share is the share of label 0 among all rows of which x is a sample; if one label is
    missing, every document gets the other.
    """
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        k = x.shape[1] if x.ndim == 2 else len(FEATURES)
        return Ranking(np.zeros(k), np.ones(k), np.zeros(2 * k), cut=-1.0 if len(good) else 1.0)
    spread = x.std(axis=0)
    model = Ranking(x.mean(axis=0), np.where(spread > 1e-9, spread, 1.0), np.zeros(2 * x.shape[1]))
    rng = np.random.default_rng(seed)
    e = model.expand(x)
    d = e[rng.choice(good, pairs)] - e[rng.choice(bad, pairs)]
    v = model.weights
    for _ in range(rounds):
        q = 1 / (1 + np.exp(np.clip(d @ v, -30, 30)))
        gradient = -(d * q[:, None]).mean(axis=0) + ridge * v
        hessian = (d.T * (q * (1 - q))) @ d / pairs + ridge * np.eye(len(v))
        step = np.linalg.solve(hessian, gradient)
        v = v - step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = v
    s = model.strength(x)
    weight = np.where(label == 1, (1 - bad_share) / len(good), bad_share / len(bad))
    order = np.argsort(s, kind="stable")
    k = min(int(np.searchsorted(np.cumsum(weight[order]), bad_share)), len(s) - 1)
    model.cut = float((s[order][k] + s[order][max(k - 1, 0)]) / 2)
    model.steep = float(4 / max(np.quantile(s, 0.9) - np.quantile(s, 0.1), 1e-6))
    return model


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of each document's whole text."""

    def run(batches):
        for batch in batches:
            for piece in tv.pieces(batch.column(1)):
                x = features(piece)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(piece.lo, piece.n) for i, c in enumerate(batch.columns) if i != 1), lists], [*(f for i, f in enumerate(batch.schema.names) if i != 1), "features"])

    others = [f"{n} {t}" for n, t in docs.dtypes if n != "text"]
    return docs.mapInArrow(run, ", ".join([*others, "features array<double>"]))


def learn(docs: DataFrame, labels: DataFrame, column: str = "quality", holdout_parts: int = 3, holdout_part: int = 1, rows_per_label: int = 4000) -> Ranking:
    """Fit on the features of about rows_per_label documents of each label that aren't held out."""
    held = lambda c: label_part(c, holdout_parts) == holdout_part
    drawn = training_rows(docs, labels, column, held, rows_per_label).select("doc_id", "text", "label")
    rows = document_features(drawn).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["features"]))
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held(F.col("doc_id")))
    bad = known.agg(F.avg(1 - F.col(column))).first()[0]
    return fit(np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows]), float(bad or 0.0))


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """One row per document: doc_id, strength (the Bradley-Terry score) and score in 0 to 1.

    score is 0.5 at the cut. A null text is scored as an empty one, from features of zero;
    repeated rows get equal scores; columns other than doc_id and text don't matter.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranking)

    def run(batches):
        model = held.value
        for batch in batches:
            for piece in tv.pieces(batch.column(1)):
                x = features(piece)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.lo, piece.n), pa.array(model.strength(x)), pa.array(model.probability(x))], ["doc_id", "strength", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, strength double, score double")
