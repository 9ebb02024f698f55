"""Language identification of mixed text: script ranges, then Viterbi over per-word scores.

Each letter run scores under each learned language by the log-probabilities of its character
trigrams. The scripts of its letters narrow the languages down to those that were learned with
that script. Viterbi with a penalty for each change of language then labels all words of a
text, so that spans of another language stand out and single odd words do not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import label_part
from .letters import LetterWords, letter_words

#: Where blocks of one script begin, with the script (fixed values of Unicode).
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other Indic"), (0x0E00, "Thai"), (0x0E80, "Other Asian"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE70, "Arabic"), (0xFF00, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_EDGES = np.array([a for a, _ in SCRIPT_STARTS[1:]], dtype=np.uint32)
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS], dtype=np.int8)
_FAR = np.float32(-1e4)
#: Languages that one text is labelled with at most; how many of them are those that suit the whole text best.
CANDIDATES, WHOLE = 64, 16
#: Scores that are held at once while candidates are chosen.
SCORES_AT_ONCE = 1 << 24


def word_scripts(w: LetterWords) -> np.ndarray:
    """The script of each word's first letter."""
    return _SCRIPT[np.searchsorted(_EDGES, w.letters[w.words[:-1]], side="right")]


@dataclass
class Model:
    """What is learned: languages, log-probabilities [bucket, language], scripts of each."""

    languages: list[str]
    bits: int
    table: np.ndarray
    allowed: np.ndarray
    penalty: float

    def word_scores(self, w: LetterWords) -> np.ndarray:
        if not len(w.words) - 1:
            return np.zeros((0, len(self.languages)), np.float32)
        scores = np.add.reduceat(self.table[w.trigrams(self.bits)], w.words[:-1], axis=0)
        allowed = self.allowed[word_scripts(w)]
        scores[~allowed] = _FAR
        return scores

    def narrowed(self, w: LetterWords) -> Model:
        """The model of the languages that a text may be in: those that suit the whole text best, then those that suit most of its words best."""
        k, n = len(self.languages), len(w.words) - 1
        total, wins, lo = np.zeros(k), np.zeros(k, dtype=np.int64), 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(w.words, w.words[lo] + SCORES_AT_ONCE // k, side="right")) - 1)
            scores = self.word_scores(part_of(w, lo, hi))
            total += scores.sum(axis=0)
            wins += np.bincount(scores.argmax(axis=1), minlength=k)
            lo = hi
        first = np.argsort(-total, kind="stable")[:WHOLE]
        rest = np.argsort(-wins, kind="stable")
        some = np.sort(np.concatenate([first, rest[~np.isin(rest, first)][: CANDIDATES - WHOLE]]))
        return Model([self.languages[i] for i in some], self.bits, np.ascontiguousarray(self.table[:, some]), self.allowed[:, some], self.penalty)


def part_of(w: LetterWords, lo: int, hi: int) -> LetterWords:
    """Words lo to hi as one row."""
    a, b = w.words[lo], w.words[hi]
    return LetterWords(w.letters[a:b], w.words[lo : hi + 1] - a, np.array([0, hi - lo]))


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word, row by row: word scores minus a penalty for each change.

    All rows advance together, the longer ones first in order, so that step t is one numpy
    operation over the rows that have a word t. Ties go to the smaller label.
    """
    counts = np.diff(bounds)
    order = np.argsort(-counts, kind="stable")
    first, counts = bounds[:-1][order], counts[order]
    steps = int(counts[0]) if len(counts) else 0
    label = np.zeros(len(scores), dtype=np.int16)
    if not steps:
        return label
    alive = np.searchsorted(-counts, -np.arange(1, steps + 1), side="right")
    kind = np.int8 if scores.shape[1] <= 128 else np.int16
    back = np.zeros(scores.shape, dtype=kind)
    own = np.arange(scores.shape[1], dtype=kind)
    best = scores[first[: alive[0]]].astype(np.float64)
    for t in range(1, steps):
        n = alive[t]
        if n < len(best):
            label[first[n : len(best)] + t - 1] = best[n:].argmax(axis=1)
            best = best[:n]
        top = best.argmax(axis=1)
        jump = best[np.arange(n), top] - penalty
        stay = best >= jump[:, None]
        at = first[:n] + t
        back[at] = np.where(stay, own, top[:, None])
        best = np.maximum(best, jump[:, None]) + scores[at]
    label[first[: len(best)] + steps - 1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        at = first[: alive[t]] + t
        label[at - 1] = back[at, label[at]]
    return label


def learn(docs: DataFrame, holdout_parts: int = 5, rows_per_language: int = 2000, bits: int = 15, penalty: float = 8.0, most_languages: int = 8192) -> Model:
    """Learn from text and non-null lang of the documents that aren't held out.

    At most about rows_per_language documents of each language are read, drawn by a hash of
    their ids, and all languages, or the most_languages that most documents have. Character
    statistics are counted in tasks; the driver gets their tables, which have fewer than 2**bits
    columns a language if there are over 256. Texts of any length are read whole; an empty
    table, or one without a language, gives a model without languages.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where((label_part(F.col("doc_id"), holdout_parts) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    languages = sorted(r["lang"] for r in counts)
    while bits > 8 and len(languages) << bits > 1 << 23:
        bits -= 1
    if not languages:
        return Model([], bits, np.zeros((1 << bits, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool), penalty)
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, rows_per_language / r["n"]) * (1 << 30))) for r in counts], "lang string, share long")
    drawn = known.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share")).select("lang", "text")  # most_languages rows

    def run(batches):
        grams = np.zeros((len(languages), 1 << bits), dtype=np.int64)
        scripts = np.zeros((len(languages), len(SCRIPTS)), dtype=np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            lang = batch.column(0).to_pylist()
            for piece in tv.pieces(batch.column(1)):
                w = letter_words(piece)
                if not len(w.letters):
                    continue
                of_row = np.array([place[x] for x in lang[piece.lo : piece.hi]])
                of_word = np.repeat(of_row, np.diff(w.rows))
                of_letter = np.repeat(of_word, w.lengths)
                grams += np.bincount(of_letter * (1 << bits) + w.trigrams(bits), minlength=grams.size).reshape(grams.shape)
                scripts += np.bincount(of_word * len(SCRIPTS) + word_scripts(w), minlength=scripts.size).reshape(scripts.shape)
        yield pa.RecordBatch.from_arrays([pa.array([grams.tobytes()], pa.binary()), pa.array([scripts.tobytes()], pa.binary())], ["grams", "scripts"])

    grams, scripts = np.zeros((len(languages), 1 << bits), np.int64), np.zeros((len(languages), len(SCRIPTS)), np.int64)
    for row in drawn.coalesce(8).mapInArrow(run, "grams binary, scripts binary").toLocalIterator():
        grams += np.frombuffer(row["grams"], np.int64).reshape(grams.shape)
        scripts += np.frombuffer(row["scripts"], np.int64).reshape(scripts.shape)
    p = (grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * grams.shape[1])
    # a script is a language's if a hundredth of its words are written in it
    allowed = (scripts >= np.maximum(1, 0.01 * scripts.sum(axis=1, keepdims=True))).T
    return Model(languages, bits, np.ascontiguousarray(np.log(p).T.astype(np.float32)), allowed, penalty)


def _labelled(model: Model, ids: pa.Array, parts: list[LetterWords]) -> pa.RecordBatch:
    """The result rows of some pieces, which are labelled together."""
    scores = np.concatenate([model.word_scores(w) for w in parts])
    n_words = np.concatenate([np.diff(w.rows) for w in parts])
    weights = np.concatenate([w.lengths for w in parts])
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    labels = viterbi(scores, bounds, model.penalty)
    readable = scores[np.arange(len(labels)), labels] > _FAR if len(labels) else np.zeros(0, bool)
    rows = np.repeat(np.arange(len(n_words)), n_words)
    k = len(model.languages)
    letters = np.bincount(rows * k + labels, weights=weights * readable, minlength=len(n_words) * k).reshape(-1, k)
    best, total = letters.argmax(axis=1), letters.sum(axis=1)
    new = np.ones(len(labels), dtype=bool)
    new[1:] = (labels[1:] != labels[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    span_of = np.concatenate([[0], np.cumsum(np.bincount(rows[at], minlength=len(n_words)))])
    names = pa.array(model.languages)
    spans = pa.StructArray.from_arrays(
        [names.take(pa.array(labels[at])), pa.array((at - bounds[rows[at]]).astype(np.int32)), pa.array(np.diff(np.append(at, len(labels))).astype(np.int32))],
        ["lang", "first_word", "n_words"],
    )
    pred = names.take(pa.array(np.where(n_words > 0, best, 0)))
    pred = pa.array([p if n else "und" for p, n in zip(pred.to_pylist(), n_words.tolist(), strict=True)])
    score = letters.max(axis=1) / np.maximum(total, 1)
    return pa.RecordBatch.from_arrays([ids, pred, pa.array(score), pa.ListArray.from_arrays(pa.array(span_of.astype(np.int32)), spans)], ["doc_id", "lang_pred", "score", "spans"])


def _batches(model: Model, batches, id_col: str, text_col: str, group_bytes: int):
    """(batch, first row, result rows) of all batches, group by group."""
    for batch in batches:
        ids, text = batch.column(id_col), batch.column(text_col)
        if not model.languages:
            n = batch.num_rows
            none = pa.array([[]] * n, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])))
            yield batch, 0, pa.RecordBatch.from_arrays([ids, pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n)), none], ["doc_id", "lang_pred", "score", "spans"])
            continue
        parts, size, lo = [], 0, 0
        if len(model.languages) > CANDIDATES:
            for piece in tv.pieces(text):
                w = letter_words(piece)
                for i in range(piece.n):
                    own = part_of(w, w.rows[i], w.rows[i + 1])
                    yield batch, piece.lo + i, _labelled(model.narrowed(own), ids.slice(piece.lo + i, 1), [own])
            continue
        for piece in tv.pieces(text):
            parts.append(letter_words(piece))
            size += len(piece.data)
            if size >= group_bytes or piece.hi == batch.num_rows:
                yield batch, lo, _labelled(model, ids.slice(lo, piece.hi - lo), parts)
                parts, size, lo = [], 0, piece.hi


SPANS = "array<struct<lang:string,first_word:int,n_words:int>>"


def identify(docs: DataFrame, model: Model, group_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, lang_pred, score and the labelled spans of letter words.

    lang_pred is the language with most letters, score its share of all letters whose words are
    in a learned script. A text that is null or has no letter is `und` with score 0 and no
    spans; so is every text if nothing was learned. A text all of whose letters are in scripts
    that no learned language uses is given the learned language of the smallest name among its
    candidates, score 0. A text has at most CANDIDATES languages to be labelled with. Texts of any
    length are labelled whole, an empty table gives no rows. Repeated rows get equal results, and other columns don't matter.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for _, _, out in _batches(held.value, batches, "doc_id", "text", group_bytes):
            yield out

    return narrow.mapInArrow(run, f"doc_id long, lang_pred string, score double, spans {SPANS}")


def identified_documents(docs: DataFrame, model: Model, least_score: float = 0.5, group_bytes: int = 8 << 20) -> DataFrame:
    """The documents whose language is told with at least least_score, with all their columns.

    Texts that are null or have no letter go, and so do all if nothing was learned.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, lo, out in _batches(held.value, batches, "doc_id", "text", group_bytes):
            known = np.array([x != "und" for x in out.column("lang_pred").to_pylist()], dtype=bool)
            yield batch.slice(lo, out.num_rows).filter(pa.array(known & (out.column("score").to_numpy() >= least_score)))

    return docs.mapInArrow(run, docs.schema)
