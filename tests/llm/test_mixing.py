"""Mixing of sources: targets against water filling, rates against the optimality conditions, rounding."""

import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fillweave.llm import mixing, queries


def filled(sizes, weights, cap):
    """Targets by sharing again until none is above its limit."""
    total, full, left = sum(sizes), set(), Fraction(sum(sizes))
    while True:
        left = Fraction(total) - sum(cap * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        target = [Fraction(cap * sizes[i]) if i in full else left * weights[i] / w for i in range(len(sizes))]
        above = {i for i in range(len(sizes)) if i not in full and target[i] > cap * sizes[i]}
        if not above or not w:
            return target
        full |= above


def words(n):
    return " ".join(["w"] * n)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)


def check(rows, got, cap=3):
    """got has a row for each of rows (doc_id, source, text) with the sums that the contract asks for."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    names = sorted({s for _, s, _ in rows if s is not None}, key=lambda s: [ord(c) for c in s]) + ([None] if any(s is None for _, s, _ in rows) else [])
    sizes = [sum(size(t) for _, s, t in rows if s == name) for name in names]
    target = dict(zip(names, filled(sizes, [1 + i % 3 for i in range(len(names))], cap), strict=True)) if sum(sizes) else {n: 0 for n in names}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((d is None, d or 0, size(t)) for d, _, t in rows)
    source = {d: s for d, s, _ in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[names.index(s)]
        assert r["target"] == pytest.approx(float(target[s]), rel=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= cap
    for name in names:
        mine = [r for r in got if source[r["doc_id"]] == name]
        least = min((r["size"] for r in mine if r["size"]), default=0)
        assert abs(sum(r["taken"] for r in mine) - float(target[name])) <= max(1, least) + 0.02 * float(target[name])
        # every rate is an exponential tilt of the size, cut off at the cap
        tilts = [math.log(r["rate"]) / r["size"] for r in mine if r["size"] and r["rate"] < cap - 1e-9]
        assert not tilts or max(tilts) - min(tilts) <= 1e-9
        if tilts or any(r["size"] for r in mine):
            assert sum(r["rate"] * r["size"] for r in mine) == pytest.approx(float(target[name]), rel=1e-6)


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = []
    for name, n, longest in (("a", 60, 40), ("b", 300, 200), ("é", 20, 9), ("\U0001f600", 30, 30), (None, 80, 60), ("B", 1, 500)):
        rows += [(len(rows) + i, name, words(rng.randint(0, longest))) for i in range(n)]
    out = mixing.mix(docs_of(spark, rows))
    got = out.collect()
    check(rows, got)
    again = mixing.mix(docs_of(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_hot_group(spark):
    rows = [(i, "hot", words(7)) for i in range(3000)] + [(3000 + i, "x", words(1 + i % 5)) for i in range(40)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    check(rows, got)


def test_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert sum(r["taken"] for r in got) == pytest.approx(sum(r["size"] for r in got), rel=0.01)
    assert mixing.mix(no_docs).count() == 0
    empty = docs_of(spark, [(1, "a", None), (2, "b", "")])
    assert [(r["target"], r["taken"]) for r in mixing.mix(empty).collect()] == [(0.0, 0), (0.0, 0)]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op11_entropy_mix(spark, sf_dir)
    full = mixing.mix(docs).collect()
    check([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()], full)
    assert got.select(F.sum("taken")).first()[0] == sum(r["taken"] for r in full)
