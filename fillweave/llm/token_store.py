"""Token ids in binary segments with a minimal perfect hash index.

Documents are put in order of their ids by a range partitioning and encoded; each partition is
cut into segments of bounded size. A segment holds its documents' ids end to end as raw
little-endian integers (2 bytes each where the vocabulary allows, else 4) and an index that
maps a document key to its place in them:

* levels of bit arrays: a key belongs to the first level where its bit is set; a level's bits
  are set for the keys that collide with no other there, and the rest go on to the next level;
* the rank of that bit among all set bits is the key's slot, so n keys have the slots 0 to n-1;
* by slot, a 32-bit fingerprint of the key (a foreign key is told with probability 1 - 2**-32),
  the offset of its ids in the segment and their number.

A look-up takes the one segment whose range of ids has the key (segments are in order of ids, so
more than one only where equal ids go over a segment's end) and reads a few words of its index,
whatever the number of keys. The list of keys is stored for reading all documents back; look-ups
don't read it. Segments are rows of a Parquet table, because any store that Spark writes to takes
those; the ranges stand in columns of their own, which make the directory of segments.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .bpe import encoder
from .common import documents, shared_dir

SEGMENT_SCHEMA = "part int, segment int, local_start long, n_docs int, n_tokens long, width int, least long, most long, null_ids int, keys array<long>, index binary, payload binary"
_MAGIC = 0x46574958
_U = np.uint64
_GAMMA = 2


def document_keys(ids: np.ndarray, null: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """The key hashed for a document: its id (or that it has none) and how often it came before."""
    return tv.mix(tv.mix(ids.astype(np.uint64)) + (repeat.astype(np.uint64) << _U(1)) + null.astype(np.uint64))


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (tv.mix(keys ^ tv.mix(np.full(1, level + 1, np.uint64))) % _U(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys."""

    sizes: np.ndarray
    words: np.ndarray
    ranks: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, level = [], [], 0
        while len(keys):
            size = max(64, -(-_GAMMA * len(keys) // 64) * 64)
            at = _place(keys, level, size)
            hit = np.bincount(at, minlength=size)
            bits.append(hit == 1)
            sizes.append(size)
            keys = keys[hit[at] != 1]
            level += 1
            if level > 200:
                raise ValueError("the keys aren't distinct")
        flags = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
        words = np.packbits(flags, bitorder="little").view("<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])[:-1] if len(words) else np.zeros(0, np.int64)
        return cls(np.array(sizes, dtype=np.int64), words, ranks.astype(np.uint32))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has the key's bit."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = base + _place(keys[left], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & _U(1) == 1
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1))).astype(np.int64)
            out[left[here]] = (self.ranks[at >> 6] + below)[here]
            left = left[~here]
            base += size
        return out


def build_index(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The index of documents whose ids lie end to end, counts[i] of key i."""
    mph = PerfectHash.build(keys)
    slots = mph.slots(keys)
    n = len(keys)
    prints, offsets, sizes = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u8")
    prints[slots] = (tv.mix(keys + _U(1)) >> _U(32)).astype("<u4")
    offsets[slots] = np.cumsum(counts) - counts
    sizes[slots] = counts
    head = np.array([_MAGIC, n, len(mph.sizes), len(mph.words)], "<u8")
    return b"".join(x.tobytes() for x in (head, mph.sizes.astype("<u8"), mph.words.astype("<u8"), mph.ranks.astype("<u8"), offsets, sizes, prints))


class Segment:
    """Reads a segment: look-ups by key through its index, ids from its payload."""

    def __init__(self, index: bytes, payload: bytes, width: int) -> None:
        magic, n, levels, words = np.frombuffer(index, "<u8", 4).tolist()
        if magic != _MAGIC:
            raise ValueError("not a segment index")
        body = np.frombuffer(index, "<u8", levels + 2 * words + 2 * n, 32)
        sizes, bits, ranks, self.offsets, self.sizes = np.split(body, np.cumsum([levels, words, words, n]))
        self.prints = np.frombuffer(index, "<u4", n, 32 + 8 * len(body))
        self.hash = PerfectHash(sizes.astype(np.int64), bits, ranks.astype(np.uint32))
        self.ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and number of ids of each key; -1 and 0 where the segment hasn't got it."""
        if not len(self.prints):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        slots = self.hash.slots(keys)
        ok = (slots >= 0) & (self.prints[slots] == (tv.mix(keys + _U(1)) >> _U(32)).astype("<u4"))
        return np.where(ok, self.offsets[slots].astype(np.int64), -1), np.where(ok, self.sizes[slots].astype(np.int64), 0)


def _repeats(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """How often each id came before in the segment; ids come in order."""
    n = len(ids)
    new = np.ones(n, dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    at = np.flatnonzero(new)
    return np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))


def _key_arrays(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    null = np.asarray(keys.is_null())
    return keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null


def write_segments(docs: DataFrame, path: str, out: str, end_id: int | None = None, segment_tokens: int = 1 << 20, engine: str = "library", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode documents in ascending order of id and write them as segments to the table `out`.

    A null text is an empty one; a null id comes first and is a key of its own; repeated ids are
    told apart by their order within the segment. end_id, if given, closes each document. The
    range partitioning orders by id and then by a hash of the text, so that one id with very
    many rows can be split. A text of any length is encoded whole and is never cut by a segment's
    end; an empty table gives a table without segments; other columns don't matter.
    """

    def run(batches):
        coder = encoder(path, engine)
        width = 2 if max(coder.vocab.size - 1, end_id or 0) < 1 << 16 else 4
        part, segment, start = TaskContext.get().partitionId(), 0, 0
        keys, counts, parts = [], [], []
        held = 0

        def flush():
            nonlocal segment, start, held
            column = pa.concat_arrays(keys)
            n = np.concatenate(counts)
            ids, null = _key_arrays(column)
            index = build_index(document_keys(ids, null, _repeats(ids, null)), n)
            payload = np.concatenate(parts).astype("<u2" if width == 2 else "<u4").tobytes()
            real = ids[~null]
            row = [part, segment, start, len(column), held, width, *((int(real[0]), int(real[-1])) if len(real) else (None, None)), int(null.sum())]
            lists = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            out_row = pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(row, kinds, strict=True)), lists, pa.array([index], pa.binary()), pa.array([payload], pa.binary())], names=[c.split()[0] for c in SEGMENT_SCHEMA.split(", ")])
            segment, start = segment + 1, start + held
            keys.clear(), counts.clear(), parts.clear()
            held = 0
            return out_row

        for batch in batches:
            for piece in tv.pieces(batch.column(1)):
                ids, bounds = coder.encode(piece)
                n = np.diff(bounds)
                if end_id is not None:
                    ids = np.insert(ids, bounds[1:], end_id)
                    n = n + 1
                ends, own, at = np.cumsum(n), batch.column(0).slice(piece.lo, piece.n), 0
                while at < piece.n:
                    done = int(ends[at - 1]) if at else 0
                    # up to the document that fills the segment
                    to = min(int(np.searchsorted(ends, done + segment_tokens - held)) + 1, piece.n)
                    keys.append(own.slice(at, to - at))
                    counts.append(n[at:to])
                    parts.append(ids[done : int(ends[to - 1])])
                    held += int(ends[to - 1]) - done
                    at = to
                    if held >= segment_tokens:
                        yield flush()
        if keys:
            yield flush()

    ordered = documents(docs, id_col, text_col)
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(out)


def read_documents(spark, out: str) -> DataFrame:
    """Every document of a segment table, found through the index: its id, place and ids."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(out)
    totals = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, width, index, payload = (batch.column(c)[i].as_py() for c in ("part", "local_start", "width", "index", "payload"))
                column = batch.column("keys")[i].values
                ids, null = _key_arrays(column)
                segment = Segment(index, payload, width)
                offsets, counts = segment.find(document_keys(ids, null, _repeats(ids, null)))
                if (offsets < 0).any():
                    raise ValueError("a document key is missing from its segment's index")
                wide = segment.ids.astype("<u4")
                blobs = [wide[a : a + n].tobytes() for a, n in zip(offsets.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([column, pa.array(offsets + (base[part] + start)), pa.array(counts), pa.array(blobs, pa.binary())], ["doc_id", "start", "n_tokens", "ids_le32"])

    return segments.select("part", "local_start", "width", "keys", "index", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_le32 binary")


def segments_of(spark, out: str, doc_id: int | None) -> DataFrame:
    """The segments whose range of ids has one id, without their lists of keys."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(out)
    has = F.col("null_ids") > 0 if doc_id is None else (F.col("least") <= doc_id) & (F.col("most") >= doc_id)
    return segments.where(has).select("part", "segment", "width", "index", "payload")


def look_up(spark, out: str, doc_id: int | None) -> list[list[int]]:
    """The ids of the documents with one id; empty if there is none."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, number, width, index, payload = (c[i].as_py() for c in batch.columns)
                segment, repeat = Segment(index, payload, width), 0
                while True:
                    key = document_keys(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([repeat]))
                    (at,), (n,) = segment.find(key)
                    if at < 0:
                        break
                    ids = segment.ids[at : at + n].tolist()
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()), "repeat": pa.array([repeat], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int64()))})
                    repeat += 1

    rows = segments_of(spark, out, doc_id).mapInArrow(run, "part int, segment int, repeat int, ids array<long>")
    return [r["ids"] for r in sorted(rows.collect(), key=lambda r: (r["part"], r["segment"], r["repeat"]))]


def store_documents(docs: DataFrame, path: str, end_id: int | None = None, **options) -> DataFrame:
    """Write documents to a new segment table in the shared folder and read them back."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/token-segments-{uuid.uuid4().hex}"
    write_segments(docs, path, out, end_id, **options)
    return read_documents(spark, out)


