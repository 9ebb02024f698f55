"""Patches by rings against a search face by face, and chains of maps step by step."""

import random

import pytest

from fillweave.operators import patches


def rings(faces, seeds, share):
    done, front, ring = {f: 0 for f in seeds if f in faces}, set(seeds) & set(faces), 0
    while len(done) < share * len(faces) and front:
        ring += 1
        corners = {v for f in front for v in faces[f]}
        front = {f for f, vs in faces.items() if f not in done and corners & set(vs)}
        done |= dict.fromkeys(front, ring)
    return done


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_patch(spark, share):
    """Two separate strips of triangles: a patch ends where nothing is left to reach."""
    faces = {i: (i, i + 1, i + 2) for i in range(40)} | {100 + i: (100 + i, 101 + i, 102 + i) for i in range(15)}
    table = spark.createDataFrame([(f, *vs) for f, vs in faces.items()], "f int, a int, b int, c int")
    seeds = spark.createDataFrame([(3,), (3,), (30,), (999,)], "f int")
    got = {r["f"]: r["ring"] for r in patches.patch(table, seeds, share).collect()}
    assert got == rings(faces, [3, 30, 999], share)
    assert patches.patch(table.limit(0), seeds, share).count() == 0


def test_chain(spark):
    rng = random.Random(2)
    maps, sizes = [], [30, 28, 33, 20, 25, 25]
    for old, new in zip(sizes, sizes[1:], strict=False):
        kept = rng.sample(range(old), min(old, new) - 3)
        maps.append([(k, kept[k] if k < len(kept) else -1) for k in range(new)])
    want = {k: k for k in range(sizes[0])}
    for m in maps:
        want = {new: want.get(old, -1) if old >= 0 else -1 for new, old in m}
    got = patches.composed_chain([spark.createDataFrame(m, "new_v int, old_v int") for m in maps])
    assert {r["new_v"]: r["old_v"] for r in got.collect()} == want
    with pytest.raises(ValueError, match="no map"):
        patches.composed_chain([])


@pytest.mark.parametrize("share", [0.0, 0.2, 0.6, 1.0])
def test_patch_across_ranges(spark, share):
    """Rings that go back and forth between ranges of ids, as shuffled ids make them, are those of a search face by face."""
    rng = random.Random(7)
    ids = rng.sample(range(-60, 200), 120)
    faces = {f: (i, i + 1, i + 2) for i, f in enumerate(ids[:70])} | {f: tuple(rng.sample(range(72, 110), 3)) for f in ids[70:]}
    table = spark.createDataFrame([(f, *vs) for f, vs in faces.items()], "f int, a int, b int, c int")
    got = patches.patch(table, spark.createDataFrame([(ids[4],), (ids[80],)], "f int"), share, 40)
    assert {r["f"]: r["ring"] for r in got.collect()} == rings(faces, [ids[4], ids[80]], share)


def test_rounds_of_long_strips(spark, monkeypatch):
    """A strip of 600 rings in three ranges of ids takes a few tables, not some for each ring."""
    made = []
    table = patches.Scratch.table
    monkeypatch.setattr(patches.Scratch, "table", lambda self, df: made.append(1) or table(self, df))
    faces = {i: (i, i + 1, i + 1) for i in range(600)}
    strip = spark.createDataFrame([(f, *vs) for f, vs in faces.items()], "f int, a int, b int, c int")
    got = patches.patch(strip, spark.createDataFrame([(0,)], "f int"), 1.0, 200)
    assert {r["f"]: r["ring"] for r in got.collect()} == {i: i for i in range(600)}
    assert len(made) <= 25
