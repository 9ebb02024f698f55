"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's bytes are the leaves' symbols; leaf i of the tree holds the rank of the pair that
starts at symbol i together with i, an inner node the smaller of its two children. The root so
is the leftmost pair of lowest rank. Merging it changes three leaves (the merged pair, the pair
before it, and the pair that its right symbol began), and each change runs up the tree in
logarithmically many steps, until no pair can be merged. The trees of all unseen pre-tokens of
a piece of text stand as rows of one matrix, so that one numpy step moves every tree on.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa

from . import textvec as tv

_NONE = np.int64(1 << 62)
_POS = 32
#: The code points that are white space in the sense of Unicode's property (fixed values).
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[WHITE_SPACE] = _SPACE
    return table


def pretokens(piece: tv.Piece, special: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of a piece's pre-tokens.

    The pattern is that of byte-level vocabularies: contractions after an apostrophe; an
    optional blank with a run of letters, of numbers or of other characters; white space,
    of which the last character before a word stands apart. Rows, and the special token's
    occurrences, bound pre-tokens like ends of text.
    """
    if not len(piece.data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp, at = tv.code_points(piece)
    n = len(cp)
    kind = _classes()[cp]
    edge = np.zeros(n + 1, dtype=bool)
    to_cp = (lambda b: b) if n == len(piece.data) else (lambda b: np.searchsorted(at, b))
    edge[to_cp(piece.bounds)] = True
    edge[0] = edge[n] = True
    kept = None
    if special and special in (raw := bytes(piece.data)):
        found, i = [], raw.find(special)
        while i >= 0:
            found.append(i)
            i = raw.find(special, i + len(special))
        kept = to_cp(np.array(found)), to_cp(np.array(found) + len(special))
        edge[kept[0]] = edge[kept[1]] = True
    before = np.empty(n, dtype=np.uint8)
    before[0] = _SPACE
    before[1:] = kind[:-1]
    space = kind == _SPACE
    # the class changes here, or a text begins
    start = (kind != before) | edge[:n]
    # the last white space before a word begins a pre-token, and a blank takes the word along
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n])
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    quote = np.flatnonzero(start & (cp == 39))
    if len(quote):
        long = np.concatenate([cp, np.zeros(3, np.uint32)])
        open2 = quote + 1 < n
        open2[open2] &= ~edge[quote[open2] + 1]
        a, b = long[quote + 1], long[quote + 2]
        open3 = open2 & (quote + 2 < n)
        open3[open3] &= ~edge[quote[open3] + 2]
        one = open2 & np.isin(a, [ord(c) for c in "stmd"])
        two = open3 & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        start[quote[one | two] + 1] = False
        for q, width in ((quote[one], 2), (quote[two & ~one], 3)):
            start[(q + width)[q + width < n]] = True
    if kept is not None:
        for a, b in zip(*map(np.ndarray.tolist, kept), strict=True):
            start[a + 1 : b] = False
    first = np.flatnonzero(start)
    starts = at[first]
    return starts, np.append(starts[1:], len(piece.data))


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_alphabet()
        back = {c: b for b, c in enumerate(letters)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if len(added) > 1:
            raise ValueError("one added token at most is supported")
        self.special = next(iter(added), None)
        self.special_bytes = self.special.encode() if self.special else None
        self.special_id = added.get(self.special)
        self.size = max([*vocab.values(), *added.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = token.encode() if token in added else bytes(back[c] for c in token)
        for token, i in added.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for c in letters], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self._keys, self._ranks = key[order], order.astype(np.int64)
        self.decimal = [b"%d" % i for i in range(self.size)]

    def pair_keys(self, left: np.ndarray, right: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """rank << 32 | position of each pair, or _NONE where the pair can't be merged."""
        want = left * self.size + right
        at = np.searchsorted(self._keys, want)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == want, (self._ranks[at] << _POS) | pos, _NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each row of symbols (the first lengths[i] of row i count); returns ids, counts.

        Rows are pre-tokens, each with its own segment tree in a row of one matrix.
        """
        rows, width = symbols.shape
        leaves = 1 << max(0, (width - 2).bit_length())
        sym = np.concatenate([symbols, np.zeros((rows, 1), np.int64)], axis=1)
        col = np.arange(width)
        nxt = np.tile(np.arange(1, width + 2), (rows, 1))
        prv = np.tile(np.arange(-1, width), (rows, 1))
        tree = np.full((rows, 2 * leaves), _NONE, dtype=np.int64)
        r, c = np.nonzero(col[None, : width - 1] < (lengths - 1)[:, None])
        tree[r, leaves + c] = self.pair_keys(sym[r, c], sym[r, c + 1], c)
        half = leaves
        while half > 1:
            np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2], out=tree[:, half // 2 : half])
            half //= 2
        alive = np.broadcast_to(col < lengths[:, None], (rows, width)).copy()
        run = np.flatnonzero(tree[:, 1] != _NONE)
        while len(run):
            root = tree[run, 1]
            pos = root & ((1 << _POS) - 1)
            sym[run, pos] = self.merged[root >> _POS]
            right = nxt[run, pos]
            after = nxt[run, right]
            alive[run, right] = False
            nxt[run, pos] = after
            n = lengths[run]
            inner = after < n
            prv[run[inner], after[inner]] = pos[inner]
            left = prv[run, pos]
            outer = left >= 0
            value = np.full((3, len(run)), _NONE, dtype=np.int64)
            value[1, inner] = self.pair_keys(sym[run[inner], pos[inner]], sym[run[inner], after[inner]], pos[inner])
            value[2, outer] = self.pair_keys(sym[run[outer], left[outer]], sym[run[outer], pos[outer]], left[outer])
            # the right symbol may have been the row's last, which has no leaf of its own
            node = np.stack([np.where(right < n - 1, right, pos), pos, np.where(outer, left, pos)]) + leaves
            value[0] = np.where(right < n - 1, _NONE, value[1])
            value[2] = np.where(outer, value[2], value[1])
            tree[run[None, :], node] = value
            while leaves > 1 and node[0, 0] > 1:
                node = node >> 1
                tree[run[None, :], node] = np.minimum(tree[run[None, :], 2 * node], tree[run[None, :], 2 * node + 1])
            run = run[tree[run, 1] != _NONE]
        return sym[:, :width][alive], alive.sum(axis=1)

    def segment_tree_ids(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of each pre-token, end to end, and how many each has."""
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        counts = np.zeros(len(tokens), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        bits = np.array([int(s - 1).bit_length() for s in sizes.tolist()])
        for b in np.unique(bits):
            chosen = np.flatnonzero(bits == b)
            width = int(sizes[chosen].max())
            step = max(1, (1 << 18) // width)
            for i in range(0, len(chosen), step):
                some = chosen[i : i + step]
                n = sizes[some]
                flat = np.frombuffer(b"".join(tokens[k] for k in some.tolist()), dtype=np.uint8)
                square = np.zeros((len(some), max(width, 2)), dtype=np.int64)
                square[np.arange(square.shape[1]) < n[:, None]] = self.byte_ids[flat]
                ids, count = self.merge(square, n)
                counts[some] = count
                parts.append((some, ids, count))
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        for some, ids, count in parts:
            out[_ranges((ends - counts)[some], count)] = ids
        if self.special_bytes is not None and (special := [k for k, t in enumerate(tokens) if t == self.special_bytes]):
            ids = np.split(out, ends[:-1])
            for k in special:
                ids[k], counts[k] = np.array([self.special_id]), 1
            out = np.concatenate(ids)
        return out, counts

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers start, start + 1, ... of each range, end to end."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Encodes pieces of text; pre-tokens met before are looked up in a table of fixed size.

    engine "tree" merges unseen pre-tokens with the segment tree, "library" has the tokenizers
    library encode them. The table has one slot for each value of some hash bits and keeps the
    pre-token met last; all of it is dropped when the ids it holds pass a limit. So memory is
    bounded, whatever the corpus.
    """

    def __init__(self, path: str, engine: str = "tree", slot_bits: int = 19, most_rows: int = 1_000_000) -> None:
        self.vocab = vocabulary(path)
        self.engine, self.slot_bits, self.most_rows = engine, slot_bits, most_rows
        if engine == "library":
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
        elif engine != "tree":
            raise ValueError(f"no such engine: {engine}")
        self._reset()

    def _reset(self) -> None:
        self.hashes = np.zeros(1 << self.slot_bits, dtype=np.uint64)
        self.row_at = np.full(1 << self.slot_bits, -1, dtype=np.int32)
        self.start = np.zeros(1 << 12, dtype=np.int64)
        self.count = np.zeros(1 << 12, dtype=np.int32)
        self.ids = np.zeros(1 << 14, dtype=np.int32)
        self.rows = self.used = 0

    def _room(self, rows: int, ids: int) -> None:
        for name, need in (("start", self.rows + rows), ("count", self.rows + rows), ("ids", self.used + ids)):
            have = getattr(self, name)
            if len(have) < need:
                setattr(self, name, np.concatenate([have, np.zeros(max(need - len(have), len(have)), have.dtype)]))

    def _unseen(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.engine == "tree":
            return self.vocab.segment_tree_ids(tokens)
        found = [e.ids for e in self.library.encode_batch_fast([t.decode() for t in tokens], add_special_tokens=False)]
        counts = np.array([len(x) for x in found], dtype=np.int64)
        return np.fromiter((i for x in found for i in x), dtype=np.int64, count=int(counts.sum())), counts

    def encode(self, piece: tv.Piece) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a piece's rows end to end, and each row's bounds in them."""
        if self.rows > self.most_rows:
            self._reset()
        starts, ends = pretokens(piece, self.vocab.special_bytes)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(piece.n + 1, np.int64)
        hashes = tv.span_hashes(piece.data, starts, ends)
        slots = (hashes >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        rows = np.where(self.hashes[slots] == hashes, self.row_at[slots], -1)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            first = missing[first]
            ids, counts = self._unseen(tv.strings(piece.data, starts[first], ends[first]))
            self._room(len(new), len(ids))
            at = np.arange(self.rows, self.rows + len(new))
            self.ids[self.used : self.used + len(ids)] = ids
            self.start[at] = self.used + np.cumsum(counts) - counts
            self.count[at] = counts
            self.hashes[slots[first]] = new
            # of new pre-tokens that share a slot one stays, with its own row
            won = self.hashes[slots[first]] == new
            self.row_at[slots[first][won]] = at[won]
            rows[missing] = at[back]
            self.rows += len(new)
            self.used += len(ids)
        counts = self.count[rows].astype(np.int64)
        out = self.ids[_ranges(self.start[rows], counts)]
        ends_at = np.concatenate([[0], np.cumsum(counts)])
        return out, ends_at[np.searchsorted(starts, piece.bounds)]

    def encode_column(self, text: pa.Array):
        """(row, ids) of each text of a column, in order."""
        for piece in tv.pieces(text):
            ids, bounds = self.encode(piece)
            for k in range(piece.n):
                yield piece.lo + k, ids[bounds[k] : bounds[k + 1]]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=4)
def encoder(path: str, engine: str = "tree") -> Encoder:
    """The worker's own encoder of a vocabulary; later tasks of the worker find its table warm."""
    return Encoder(path, engine)


SCHEMA = "doc_id long, ids array<int>, decoded string"


def encode_documents(docs, path: str, engine: str = "tree", id_col: str = "doc_id", text_col: str = "text"):
    """One row per document: its id, its token ids, and the text that they decode to.

    A null text is read as an empty one, which has no ids; a null id stays null, and repeated
    rows give repeated results. Other columns are dropped. Texts are encoded whole; the work
    is one narrow pass over the rows, so nothing is shuffled.
    """
    from pyspark.sql import functions as F

    def run(batches):
        coder = encoder(path, engine)
        for batch in batches:
            ids_of, text = batch.column(0), batch.column(1)
            for piece in tv.pieces(text):
                ids, bounds = coder.encode(piece)
                values = ids.tolist()
                decoded = [coder.vocab.decode(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids_of.slice(piece.lo, piece.n), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)


def decode_documents(encoded, path: str, id_col: str = "doc_id", ids_col: str = "ids"):
    """One row per row of encoded: its id and the text of its ids (null ids: empty text)."""
    from pyspark.sql import functions as F

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
