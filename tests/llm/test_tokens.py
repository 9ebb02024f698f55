"""BPE against the tokenizers library, and the segment store against the encoder."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fillweave.llm import bpe, queries, token_store


@pytest.fixture(scope="module")
def library(tokenizer_path):
    t = Tokenizer.from_file(tokenizer_path)
    t.no_truncation()
    t.no_padding()
    return t


def ids(coder, texts):
    return [x.tolist() for _, x in coder.encode_column(pa.array(texts, pa.string()))]


ODD = ["", "a", "it's we'll they've I'm 'tis ''s 's's", "  two  spaces \n\n x", "tab\tx\t\ty  ", "<|endoftext|>", "a <|endoftext|> b  <|endoftext|>'s", "日本語テキスト 123４５ ½² x", "é̂ naïve x\u2028y", "q" * 5000, "ab" * 2500 + " c", "\x85a\x1cb \x1f", "x'll'd", " \n "]


@pytest.mark.parametrize("engine", ["tree", "library"])
def test_same_as_library(library, tokenizer_path, engine):
    want = [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]
    assert ids(bpe.Encoder(tokenizer_path, engine), ODD) == want


# a table of 16 slots, dropped again and again, must not change results
def test_small_table(library, tokenizer_path, odd_rows):
    texts = [t or "" for _, t, _ in odd_rows]
    coder = bpe.Encoder(tokenizer_path, slot_bits=4, most_rows=10)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids(coder, texts) == want
    assert ids(coder, texts) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tstremvld!é1²<|endoftext|>日"), st.characters(codec="utf-8"))), max_size=5))
def test_any_text(texts):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert ids(bpe.encoder(path), texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_any_ids(numbers):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.vocabulary(path).decode(numbers) == Tokenizer.from_file(path).decode(numbers, skip_special_tokens=False)


def test_codec_query(spark, sf_dir, library, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    for r in queries.op1_bpe_codec(spark, sf_dir).collect():
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_codec_of_odd_rows(odd_docs, no_docs, odd_rows, library, tokenizer_path):
    got = sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in bpe.encode_documents(odd_docs, tokenizer_path).collect())
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _ in odd_rows)
    assert got == want
    assert bpe.encode_documents(no_docs, tokenizer_path).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(odd_docs, tokenizer_path), tokenizer_path)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t, _ in odd_rows)


def test_store_query(spark, sf_dir, library, documents):
    rows = documents.orderBy("doc_id").collect()
    got = queries.op4_token_store(spark, sf_dir).orderBy("doc_id").collect()
    start = 0
    for r, g in zip(rows, got, strict=True):
        want = [*library.encode(r["text"], add_special_tokens=False).ids, 2]
        assert (g["doc_id"], g["start"], g["n_tokens"]) == (r["doc_id"], start, len(want))
        assert g["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)


def test_store_of_odd_rows(spark, odd_docs, no_docs, odd_rows, library, tokenizer_path, tmp_path):
    out = str(tmp_path / "s")
    token_store.write_segments(odd_docs, tokenizer_path, out, end_id=2, segment_tokens=1000)
    got = token_store.read_documents(spark, out).collect()
    want = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _ in odd_rows]
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids_le32"], "<u4").tolist()) for r in got) == sorted((str(i), x) for i, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_store.look_up(spark, out, 6) == [dict(want)[6]] * 2
    assert token_store.look_up(spark, out, 999) == []
    assert token_store.look_up(spark, out, 1) == [dict(want)[1]]
    assert token_store.store_documents(no_docs, tokenizer_path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 20_000])
def test_perfect_hash(n):
    keys = token_store.document_keys(np.arange(n), np.zeros(n, bool), np.zeros(n, int))
    assert sorted(token_store.PerfectHash.build(keys).slots(keys).tolist()) == list(range(n))
    counts = np.arange(n) % 5
    index = token_store.build_index(keys, counts)
    segment = token_store.Segment(index, np.zeros(int(counts.sum()), "<u2").tobytes(), 2)
    offsets, sizes = segment.find(keys)
    assert sizes.tolist() == counts.tolist()
    assert offsets.tolist() == (np.cumsum(counts) - counts).tolist()
    foreign = token_store.document_keys(np.arange(n) + 10**9, np.zeros(n, bool), np.zeros(n, int))
    assert (segment.find(foreign)[0] == -1).all()


def test_one_look_up_reads_one_segment(spark, documents, library, tokenizer_path, tmp_path):
    out = str(tmp_path / "segments")
    token_store.write_segments(documents, tokenizer_path, out, end_id=2, segment_tokens=2000)
    all_segments = spark.read.parquet(out).count()
    rows = documents.select("doc_id", "text").collect()
    assert all_segments > 20
    for r in rows[:: len(rows) // 5]:
        chosen = token_store.segments_of(spark, out, r["doc_id"])
        assert chosen.count() == 1 and "keys" not in chosen.columns
        assert token_store.look_up(spark, out, r["doc_id"]) == [library.encode(r["text"] or "", add_special_tokens=False).ids + [2]]
