"""Near duplicates against brute force and SQL."""

import random
import re
import time

import pytest

from fillweave.llm import near_dup, queries


def brute(rows, percent=75):
    """component_id by comparing all pairs; rows are (doc_id, text)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(map(str, out))


def copies(seed, base_words=60, groups=3, members=25):
    """Groups of copies of one text, each with some words replaced, from none to half of them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(base_words)]
        for k in range(members):
            w = list(base)
            for _ in range(k // 4):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    return rows


# with few smallest hashes most sets are larger than what is compared of them
@pytest.mark.parametrize(("smallest", "rows_in_block"), [(256, 1024), (24, 1024), (256, 5)])
def test_groups_of_copies(spark, smallest, rows_in_block, monkeypatch):
    rows = copies(7)
    monkeypatch.setattr(near_dup.classes_and_members, "__defaults__", (smallest, 0.4 if smallest < 256 else 0.6, rows_in_block, 8))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(str(tuple(r)) for r in near_dup.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_null_ids_link(spark):
    """A text without an id links its two neighbours, which are too far apart to link themselves."""
    w = [f"w{i}" for i in range(104)]
    other = lambda at: " ".join(x + "x" * (i in at) for i, x in enumerate(w))
    rows = [(1, other({0, 1, 2, 3, 4, 5})), (None, " ".join(w)), (None, " ".join(w)), (2, other({98, 99, 100, 101, 102, 103})), (None, "alone in the world with no one"), (None, "alone in the world with no one")]
    assert len({r[2] for r in eval("[" + ",".join(brute(rows)) + "]") if r[1] > 50}) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(str(tuple(r)) for r in near_dup.near_duplicates(docs).collect()) == brute(rows)
    assert sorted(str(tuple(r)) for r in near_dup.distinct_documents(docs).collect()) == sorted(map(str, [(1, rows[0][1]), (None, rows[4][1])]))


def test_one_of_each_group_stays(spark, odd_docs, no_docs):
    """Rows of one id with different texts are judged apart; of repeated rows one stays."""
    long = " ".join(f"v{i}" for i in range(80))
    rows = [(1, long), (1, "a text of its own that nothing else has"), (2, long), (2, long), (3, "said twice by the same row"), (3, "said twice by the same row"), (4, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in near_dup.distinct_documents(docs).collect())
    assert got == sorted([(1, long), rows[1], rows[4], (4, ""), (4, "")])
    assert near_dup.distinct_documents(odd_docs).columns == odd_docs.columns
    assert near_dup.distinct_documents(no_docs).count() == 0


def test_repeated_ids_and_rows(spark):
    """Many texts of one id, and many rows of one text, are verified once for each text: results as by brute force, in about the time of distinct ids."""
    near = copies(11, groups=4, members=40)
    few = copies(12, groups=2, members=3)

    def timed(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        began = time.perf_counter()
        got = sorted(str(tuple(r)) for r in near_dup.near_duplicates(docs).collect())
        return got, time.perf_counter() - began

    timed(few)
    own, fast = timed(near)
    assert own == brute(near)
    shared, slow = timed([(5, t) for _, t in near])
    assert slow <= 2 * fast + 5
    assert {r.split(", ")[2] for r in shared} == {"5"}
    often, slow = timed([(d + 1000, t) for d, t in few for _ in range(2000)])
    assert slow <= 2 * fast + 5
    assert sorted(set(often)) == brute([(d + 1000, t) for d, t in few]) and len(often) == 2000 * len(few)
    docs = spark.createDataFrame([(5, t) for _, t in near] + [(d + 1000, t) for d, t in few for _ in range(500)], "doc_id long, text string")
    kept = near_dup.distinct_documents(docs.repartition(3)).collect()
    groups = len({r.split(", ")[2] for r in own})
    assert len(kept) == groups + len({r.split(", ")[2] for r in brute(few)})


def test_sketches_keep_links():
    """Sets of similarity 0.75 agree in as many bytes as asked, and far ones don't."""
    import numpy as np

    rng = np.random.default_rng(3)
    draw = lambda shared, own: np.sort(rng.integers(0, 2**63, shared + own, dtype=np.uint64))
    least = near_dup.agreeing_bytes(75)
    for shared, own, near in ((60, 10, True), (6, 1, True), (600, 100, True), (60, 60, False)):
        agree = []
        for _ in range(150):
            a = draw(shared, own)
            b = np.sort(np.concatenate([rng.permutation(a)[:shared], draw(0, own)]))
            s = near_dup._sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            agree.append((s.view(np.uint8)[0] == s.view(np.uint8)[1]).sum() >= least)
        assert np.mean(agree) == 1 if near else np.mean(agree) < 0.1


def test_odd_rows(odd_docs, no_docs, odd_rows):
    got = sorted(str(tuple(r)) for r in near_dup.near_duplicates(odd_docs).collect())
    assert got == brute([(d, t) for d, t, _ in odd_rows])
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_query(spark, sf_dir, duck, same_rows):
    same_rows(queries.op5_minhash_near_dup(spark, sf_dir).toPandas(), duck.execute(queries.SQL["op5_minhash_near_dup"]).df())


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300)] + [(500 + rng.randrange(30), 500 + rng.randrange(30)) for _ in range(25)]
    edges = [(a, b) for a, b in edges if a != b]
    got = dict(near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
