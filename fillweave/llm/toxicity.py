"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word (a run of letters, lower-cased) enters by an embedding of its own, if it is in the
learned vocabulary, and by the mean of its character trigrams' embeddings. Two gated recurrent
networks read a window of words in either direction, attention weighs their states, and a
logistic unit scores the pooled state. All overlapping windows of a text are scored; the text's
score is its highest window's. Labels are of texts, so training is by multiple instances: in
each epoch every training text is represented by its highest window so far.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import label_part
from .letters import LetterWords, letter_words

H, D_WORD, D_CHAR, BITS = 8, 6, 6, 13
_DIRS = ("f", "b")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def windows(rows: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of overlapping windows that cover each row's words whole.

    The last window of a row ends with the row; a row shorter than a window has one short one,
    a row without words none.
    """
    n = np.diff(rows)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - size) // stride)), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(k * stride, np.maximum(n[row] - size, 0)) + rows[row]
    return row, first, np.minimum(n[row], size)


@dataclass
class Network:
    """The parameters, and the vocabulary's word hashes in order."""

    vocabulary: np.ndarray
    p: dict[str, np.ndarray]
    size: int = 48
    stride: int = 32
    scale: tuple[float, float] = (1.0, 0.0)
    empty: float = 0.0

    @classmethod
    def fresh(cls, vocabulary: np.ndarray, word_odds: np.ndarray, char_odds: np.ndarray, seed: int = 11, **options) -> Network:
        rng = np.random.default_rng(seed)
        d = D_WORD + D_CHAR
        draw = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
        p = {"word": draw(len(vocabulary) + 1, D_WORD, by=0.05), "char": draw(1 << BITS, D_CHAR, by=0.05)}
        p["word"][:-1, 0], p["char"][:, 0] = word_odds, char_odds
        for s in _DIRS:
            p |= {f"x{s}": draw(d, 3 * H, by=d**-0.5), f"h{s}": draw(H, 3 * H, by=H**-0.5), f"c{s}": np.zeros(3 * H, np.float32)}
        p |= {"att": draw(2 * H, by=0.3), "out": draw(2 * H, by=0.3), "off": np.zeros(1, np.float32)}
        return cls(vocabulary, p, **options)

    def word_index(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary; its size for words that it hasn't got."""
        n = len(self.vocabulary)
        if not n:
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == n] = 0
        return np.where(self.vocabulary[at] == hashes, at, n)

    def inputs(self, w: LetterWords) -> np.ndarray:
        """The input vector of each word."""
        n = len(w.words) - 1
        x = np.empty((n, D_WORD + D_CHAR), np.float32)
        if n:
            x[:, :D_WORD] = self.p["word"][self.word_index(w.hashes())]
            x[:, D_WORD:] = np.add.reduceat(self.p["char"][w.trigrams(BITS)], w.words[:-1], axis=0)
            x[:, D_WORD:] /= w.lengths[:, None].astype(np.float32)
        return x

    def run(self, x: np.ndarray, first: np.ndarray, n: np.ndarray, keep: bool = False):
        """The logit of each window; with keep, also what the backward pass needs."""
        p, size, b = self.p, int(n.max()) if len(n) else 0, len(first)
        full = bool((n == size).all())
        states = np.empty((size, b, 2 * H), np.float32)
        kept = {}
        for s, at in zip(_DIRS, (slice(0, H), slice(H, 2 * H)), strict=True):
            gates = x @ p[f"x{s}"] + p[f"c{s}"]
            u = p[f"h{s}"]
            h = np.zeros((b, H), np.float32)
            log = []
            for t in range(size) if s == "f" else range(size - 1, -1, -1):
                where = first + t if full else first + np.minimum(t, n - 1)
                g = gates[where]
                hu = h @ u
                zr = _sigmoid(g[:, : 2 * H] + hu[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                c = np.tanh(g[:, 2 * H :] + r * hu[:, 2 * H :])
                new = c + z * (h - c)
                if not full:
                    new = np.where((t < n)[:, None], new, h)
                if keep:
                    log.append((t, where, h, z, r, c, hu[:, 2 * H :]))
                h = new
                states[t, :, at] = h
            kept[s] = log
        score = states @ p["att"]
        if not full:
            score[np.arange(size)[:, None] >= n] = -1e9
        score -= score.max(axis=0)
        weight = np.exp(score)
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbk->bk", weight, states)
        logit = pooled @ p["out"] + p["off"][0]
        return (logit, (states, weight, pooled, kept)) if keep else logit

    def gradients(self, x: np.ndarray, first: np.ndarray, n: np.ndarray, label: np.ndarray, weight_of: np.ndarray):
        """Of the weighted logistic loss over windows: parameter gradients, and x's."""
        p = self.p
        logit, (states, weight, pooled, kept) = self.run(x, first, n, keep=True)
        d = ((_sigmoid(logit) - label) * weight_of / weight_of.sum()).astype(np.float32)
        g = {"out": pooled.T @ d, "off": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * p["out"]
        d_weight = np.einsum("bk,tbk->tb", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att"] = np.einsum("tb,tbk->k", d_score, states)
        d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * p["att"]
        dx = np.zeros_like(x)
        for s, at in zip(_DIRS, (slice(0, H), slice(H, 2 * H)), strict=True):
            u, gu, gx, gc = p[f"h{s}"], np.zeros_like(p[f"h{s}"]), np.zeros_like(p[f"x{s}"]), np.zeros_like(p[f"c{s}"])
            carry = np.zeros((len(first), H), np.float32)
            places, pushed = [], []
            for t, where, h, z, r, c, hc in reversed(kept[s]):
                dh = d_states[t, :, at] + carry
                live = (t < n)[:, None].astype(np.float32)
                new = dh * live
                dz = new * (h - c) * z * (1 - z)
                dc = new * (1 - z) * (1 - c * c)
                dr = dc * hc * r * (1 - r)
                into = np.concatenate([dz, dr, dc], axis=1)
                back = np.concatenate([dz, dr, dc * r], axis=1)
                gu += h.T @ back
                gx += x[where].T @ into
                gc += into.sum(axis=0)
                places.append(where)
                pushed.append(into)
                carry = new * z + back @ u.T + dh * (1 - live)
            np.add.at(dx, np.concatenate(places), np.concatenate(pushed) @ p[f"x{s}"].T)
            g |= {f"h{s}": gu, f"x{s}": gx, f"c{s}": gc}
        return g, dx

    def document_logits(self, w: LetterWords) -> np.ndarray:
        """The highest window logit of each row; -inf for a row without words."""
        row, first, n = windows(w.rows, self.size, self.stride)
        out = np.full(len(w.rows) - 1, -np.inf, np.float64)
        if not len(row):
            return out
        x = self.inputs(w)
        logit = np.empty(len(row), np.float32)
        short = n < self.size
        for some in (np.flatnonzero(~short), np.flatnonzero(short)):
            for i in range(0, len(some), 8192):
                at = some[i : i + 8192]
                logit[at] = self.run(x, first[at], n[at])
        np.maximum.at(out, row, logit)
        return out

    def probabilities(self, w: LetterWords) -> np.ndarray:
        a, b = self.scale
        logit = self.document_logits(w)
        return np.where(np.isfinite(logit), _sigmoid(np.where(np.isfinite(logit), a * logit + b, 0.0)), self.empty)


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def _odds(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Clipped log-odds of being seen in label-1 rather than label-0 texts, shrunk by smoothing."""
    share = (seen + 0.5) / (n[:, None] + 1.0)
    return np.clip(np.log(share[1]) - np.log(share[0]), -4, 4).astype(np.float32) * 0.5


def train(texts: list[str], labels: np.ndarray, base: float | None = None, **options) -> Network:
    """Train on labelled texts; deterministic for equal inputs in equal order.

    Every fifth text is kept back to turn logits into probabilities, which are those of a corpus
    with a share `base` of label 1 (as in the texts, if not given).
    """
    labels = np.asarray(labels, dtype=np.float32)
    if base is None:
        base = float(labels.mean()) if len(texts) else 0.0
    back = np.arange(len(texts)) % 5 == 4
    if len(np.unique(labels[back])) < 2 or len(np.unique(labels[~back])) < 2:
        back[:] = False
    net = _train([t for t, b in zip(texts, back, strict=True) if not b], labels[~back], base, **options)
    if net.scale[0] > 0:
        fit = back if back.any() else ~back
        logits = net.document_logits(letter_words(tv.Piece(0, int(fit.sum()), *_joined([t for t, b in zip(texts, fit, strict=True) if b]))))
        label, ok = labels[fit], np.isfinite(logits)
        weight = np.where(label == 1, base / max(label.mean(), 1e-9), (1 - base) / max(1 - label.mean(), 1e-9))
        net.scale = _platt(logits[ok], label[ok], weight[ok])
    return net


def _train(texts: list[str], labels: np.ndarray, empty: float, most_words: int = 8_000, least_texts: int = 3, epochs: int = 10, rate: float = 0.01, seed: int = 11) -> Network:
    if not len(texts) or labels.min() == labels.max():
        return Network.fresh(np.zeros(0, np.uint64), np.zeros(0), np.zeros(1 << BITS), empty=empty, scale=(0.0, 50.0 if len(texts) and labels[0] else -50.0))
    base = float(labels.mean())
    w = letter_words(tv.Piece(0, len(texts), *_joined(texts)))
    row_of = np.repeat(np.arange(len(texts)), np.diff(w.rows))
    words, inverse = np.unique(w.hashes(), return_inverse=True)
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    pairs = np.unique(np.stack([inverse, row_of]), axis=1)
    seen = np.stack([np.bincount(pairs[0][labels[pairs[1]] == k], minlength=len(words)) for k in (0, 1)])
    often = np.flatnonzero(seen.sum(axis=0) >= least_texts)
    odds = _odds(seen[:, often], n)
    top = np.sort(often[np.argsort(-np.abs(odds) * np.sqrt(seen[:, often].sum(axis=0)), kind="stable")[:most_words]])
    grams = w.trigrams(BITS)
    letter_row = np.repeat(row_of, w.lengths)
    pairs = np.unique(np.stack([grams, letter_row]), axis=1)
    seen_c = np.stack([np.bincount(pairs[0][labels[pairs[1]] == k], minlength=1 << BITS) for k in (0, 1)])
    net = Network.fresh(words[top], _odds(seen[:, top], n), _odds(seen_c, n), seed=seed, empty=empty)

    row, first, size = windows(w.rows, net.size, net.stride)
    index = net.word_index(w.hashes())
    hint = np.concatenate([net.p["word"][:-1, 0], [0]])[index]
    running = np.concatenate([[0], np.cumsum(np.maximum(hint, 0) ** 2)])
    height = running[first + size] - running[first]
    rng = np.random.default_rng(seed)
    adam = Adam(net.p, rate)
    balance = np.where(labels == 1, 0.5 / base, 0.5 / (1 - base)).astype(np.float32)
    for epoch in range(epochs):
        if epoch:
            x = net.inputs(w)
            height = np.concatenate([net.run(x, first[i : i + 8192], size[i : i + 8192]) for i in range(0, len(first), 8192)])
        order = np.lexsort((first, -height, row))
        best = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
        # texts of label 0 also show a random window, so that not only hard ones are learned
        other = rng.integers(0, len(row), len(best))
        chosen = np.concatenate([best, other[labels[row[other]] == 0]])
        rng.shuffle(chosen)
        for i in range(0, len(chosen), 192):
            at = chosen[i : i + 192]
            used = np.unique(np.concatenate([np.arange(a, a + m) for a, m in zip(first[at].tolist(), size[at].tolist(), strict=True)]))
            x, local = _inputs_of(net, w, index, grams, used)
            g, dx = net.gradients(x, np.searchsorted(used, first[at]), size[at], labels[row[at]], balance[row[at]])
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], index[used], dx[:, :D_WORD])
            g["char"] = np.zeros_like(net.p["char"])
            per = dx[:, D_WORD:] / w.lengths[used][:, None]
            np.add.at(g["char"], local, np.repeat(per, w.lengths[used], axis=0))
            adam.step(net.p, g)
    return net


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _inputs_of(net: Network, w: LetterWords, index: np.ndarray, grams: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input vectors of some words, and the trigram buckets of their letters."""
    n = w.lengths[used]
    at = np.repeat(w.words[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    local = grams[at]
    x = np.empty((len(used), D_WORD + D_CHAR), np.float32)
    x[:, :D_WORD] = net.p["word"][index[used]]
    x[:, D_WORD:] = np.add.reduceat(net.p["char"][local], np.cumsum(n) - n, axis=0) / n[:, None]
    return x, local


def _platt(logit: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset that make the logits probabilities, by damped Newton steps.

    A small ridge draws the slope to 1 and the offset to 0.
    """

    def loss(a: float, b: float) -> float:
        x = a * logit + b
        return float((weight * (np.logaddexp(0, x) - label * x)).sum() + 0.5 * ((a - 1) ** 2 + 0.1 * b * b))

    a, b = 1.0, 0.0
    now = loss(a, b)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        s, e = weight * q * (1 - q), weight * (q - label)
        ga, gb = (e * logit).sum() + (a - 1), e.sum() + 0.1 * b
        haa, hab, hbb = (s * logit**2).sum() + 1, (s * logit).sum(), s.sum() + 0.1
        det = haa * hbb - hab * hab
        da, db, step = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det, 1.0
        while step > 1e-6 and not (a - step * da > 0.01 and loss(a - step * da, b - step * db) < now):
            step /= 2
        if step <= 1e-6:
            break
        a, b = float(a - step * da), float(b - step * db)
        now = loss(a, b)
    return a, b


def training_rows(docs: DataFrame, labels: DataFrame, column: str, held_out, rows_per_label: int) -> DataFrame:
    """text and label of a bounded sample: about rows_per_label labelled documents of each label.

    The sample is drawn by a hash of the ids; rows for which held_out(doc_id) holds are no part
    of it. Texts are taken whole, whatever their length. An id counts with one document, that of
    the smallest hash of its text, however many rows have it; an id with both labels is left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for value, n in sorted(counts.items()):
        share = F.when(F.col("label") == value, F.lit(int(min(1.0, rows_per_label / n) * (1 << 30)))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    spark = docs.sparkSession
    # at most about 2 * rows_per_label pairs of numbers
    few = spark.createDataFrame([(r["doc_id"], r["label"]) for r in drawn.collect()], "doc_id long, label int")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    one = narrow.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    return one.select("doc_id", "first.text", "label")


def learn(docs: DataFrame, labels: DataFrame, column: str = "toxic", holdout_parts: int = 5, holdout_part: int = 0, rows_per_label: int = 1500) -> Network:
    """Train on a sample of about rows_per_label whole texts of each label.

    The sample's bound lets one task train; the driver gets the parameters.
    """
    held = lambda c: label_part(c, holdout_parts) == holdout_part
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held(F.col("doc_id")))
    base = float(known.agg(F.avg(column)).first()[0] or 0.0)

    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        net = train([t for _, t, _ in rows], np.array([y for _, _, y in rows]), base)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["network"])

    drawn = training_rows(docs, labels, column, held, rows_per_label)
    trained = drawn.repartition(1).mapInArrow(run, "network binary").first()
    # without any rows no task may run
    return pickle.loads(trained["network"]) if trained else train([], np.zeros(0))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """One row per document: doc_id and score, the probability that its worst window is toxic.

    A null or empty text, or one without letters, has no window and gets the label's share in
    training. Repeated rows get equal scores; columns other than doc_id and text don't matter.
    """
    held = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = held.value
        for batch in batches:
            for piece in tv.pieces(batch.column(1)):
                value = net.probabilities(letter_words(piece)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.lo, piece.n), pa.array(value)], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double")
