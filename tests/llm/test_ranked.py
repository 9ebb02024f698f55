"""Ranked search against scores of all documents, computed one by one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fillweave.llm import queries, ranked

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score) rows; docs and items are (id, text)."""
    bags = [(d, Counter(split(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for i, text in items:
        scores = []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in split(text) if t in b)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked.best_documents(a, b, **options).collect()), key=str)


@pytest.mark.parametrize(("words", "segment", "k"), [(12, 1 << 20, 5), (300, 2000, 20), (60, 500, 3)])
def test_against_brute_force(spark, words, segment, k):
    rng = random.Random(words)
    draw = lambda n: " ".join(f"T{min(int(rng.expovariate(6 / words)), words)}" for _ in range(n))
    docs = [(i, draw(rng.randint(0, 60))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(50)] + [(None, draw(40)), (2000, None), (2001, "...")]
    items = [(i, draw(rng.randint(0, 25))) for i in range(20)] + [(50, "t1 t1 t1, unheard"), (51, None), (52, "")]
    assert run(spark, docs, items, segment_bytes=segment, k=k, items_at_once=7) == brute(docs, items, k)
    # items in blocks
    assert run(spark, docs, items, segment_bytes=segment, k=k, block_chars=200) == brute(docs, items, k)


def test_treap_cells():
    rng = np.random.default_rng(3)
    for rows, cols, n in ((1, 1, 1), (5, 300, 200), (300, 5, 200), (40, 40, 900)):
        cells = np.sort(rng.choice(rows * cols, min(n, rows * cols), replace=False))
        row, col, value = cells // cols, cells % cols, rng.integers(1, 1000, len(cells))
        t = ranked.Treap(row, col, value, rows, cols)
        assert t.largest[0] == value.max()
        # a row's path down to each of its columns ends in the value there
        for r, c, v in zip(row.tolist(), col.tolist(), value.tolist(), strict=True):
            node = np.zeros(1, np.int64)
            for level in range(t.depth):
                if t.kinds[node[0]] == 0:
                    break
                node = t.below(node, np.array([r]), np.array([level]), (c >> (t.depth - 1 - level)) & 1)
            assert (t.row[node[0]], t.col[node[0]], t.largest[node[0]]) == (r, c, v)


def test_odd_rows(spark, odd_rows, odd_docs, no_docs):
    items = [(1, "The river and the MARKET"), (2, "one two three"), (2, "日本語 ½"), (3, None)]
    want = brute([(r[0], r[1]) for r in odd_rows], [(i, t) for i, t in items], 20)
    bench = spark.createDataFrame([(*x, 1.0) for x in items], "item_id long, text string, score double")
    got = sorted((tuple(r) for r in ranked.best_documents(odd_docs, bench).collect()), key=str)
    assert got == want
    assert ranked.best_documents(no_docs, bench).count() == 0
    assert ranked.best_documents(odd_docs, bench.limit(0)).count() == 0


def test_query(spark, sf_dir, duck, same_rows):
    same_rows(queries.op12_k2_treap_search(spark, sf_dir).toPandas(), duck.execute(queries.SQL["op12_k2_treap_search"]).df())
