"""Collocations against counts of all phrases, and tiles against plain counts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from fillweave.llm import phrases, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, most=2000):
    """Rows of the result; rows are (text, lang)."""
    f = {}
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall(r"[^ \t]+", piece)
            c = f.setdefault(lang or "und", Counter())
            for k in (1, 2, 3):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(x for p, x in c.items() if len(p) == 1)
        longer = Counter()
        for p, x in c.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], x)
        found = []
        for p, a in c.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and longer[p] >= least and 100 * longer[p] >= 50 * a):
                score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "text string, lang string, rank int, phrase string").repartition(4)
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def prose(seed, docs=120, words=30):
    rng = random.Random(seed)
    rows = []
    for _ in range(docs):
        text = "".join(f"W{min(int(rng.expovariate(0.3)), words)}{rng.choice([' ', ' ', ' ', '  ', chr(9), ', ', '. ', chr(10), chr(13)])}" for _ in range(rng.randint(0, 120)))
        rows.append((text + rng.choice(["", "new york city", "new york city new york city"]), rng.choice(["en", "de", None, "und"])))
    return rows


# with few ranks and few bits most words are beyond the head, and bits are set by chance
@pytest.mark.parametrize(("ranks", "bits"), [(1 << 20, 25), (0, 25), (9, 7)])
def test_against_brute_force(spark, ranks, bits):
    rows = prose(5)
    assert run(spark, rows, most_ranks=ranks, bit_bits=bits) == brute(rows)


def test_most(spark):
    rows = prose(6)
    assert run(spark, rows, most=7, least=12) == brute(rows, least=12, most=7)


def test_tiles():
    rng = np.random.default_rng(2)
    x, y = (np.minimum(rng.geometric(0.01, 60_000), 5000) for _ in range(2))
    x[:500], y[200:700] = -x[:500] - 7, -y[200:700] - 9
    want = Counter(zip(x.tolist(), y.tolist(), strict=True))
    for dense in (1, 500, 1 << 40):
        a, b, n = phrases.tile_counts(x, y, dense, tiles_at_once=3)
        assert Counter(dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True))) == want and len(a) == len(want)


def test_odd_rows(spark, odd_rows, no_docs):
    assert run(spark, [(r[1], r[2]) for r in odd_rows]) == brute([(r[1], r[2]) for r in odd_rows])
    assert phrases.collocations(no_docs).count() == 0


def test_query(spark, sf_dir, duck, same_rows):
    same_rows(queries.op13_tiled_collocations(spark, sf_dir).toPandas(), duck.execute(queries.SQL["op13_tiled_collocations"]).df())
