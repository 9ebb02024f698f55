"""Matrix Market files: array layout by line numbers, coordinate files by ranges of bytes."""

import random

import pytest

from fillweave.sources import matrix_market as MM


@pytest.mark.parametrize("symmetry", ["general", "symmetric", "skew-symmetric"])
@pytest.mark.parametrize("parts", ["1m", "300b"])
def test_array(spark, tmp_path, symmetry, parts):
    rng = random.Random(3)
    m, n = (13, 9) if symmetry == "general" else (13, 13)
    skip = {"general": None, "symmetric": 0, "skew-symmetric": 1}[symmetry]
    want = [(r, c, rng.choice([1.0, -0.5, 3e-9]) * rng.randrange(9)) for c in range(n) for r in range(0 if skip is None else c + skip, m)]
    path = str(tmp_path / "dense")
    MM.write_array(spark.createDataFrame(want, "row int, col int, val double").repartition(5), path, m, n, symmetry)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", parts)
    try:
        got = [(r["row"], r["col"], r["val"]) for r in MM.read_array(spark, path).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted(got) == sorted(want)


def test_array_of_the_wrong_size(spark, tmp_path):
    (tmp_path / "short.mtx").write_text("%%MatrixMarket matrix array real general\n% a comment\n\n2 2\n1\n2\n3\n")
    with pytest.raises(ValueError, match="instead of 4"):
        MM.read_array(spark, str(tmp_path / "short.mtx"))
    (tmp_path / "complex.mtx").write_text("%%MatrixMarket matrix array complex hermitian\n2 2\n1 0\n2 3\n4 0\n")
    got = sorted(tuple(r) for r in MM.read_array(spark, str(tmp_path / "complex.mtx")).collect())
    assert got == [(0, 0, 1.0, 0.0), (1, 0, 2.0, 3.0), (1, 1, 4.0, 0.0)]


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_ranges_of_bytes(spark, tmp_path, split):
    rng = random.Random(5)
    want = sorted({(rng.randrange(300), rng.randrange(300)) for _ in range(200)})
    lines = ["%%MatrixMarket matrix coordinate integer general", "% sizes below", f"300 300 {len(want)}"] + [f"{r + 1}  {c + 1} {r - c}" for r, c in want]
    (tmp_path / "a.mtx").write_text("\n".join(lines))
    MM.register(spark)
    for path in (str(tmp_path / "a.mtx"), f"file://{tmp_path}/a.mtx"):
        table = spark.read.format("mtx").option("split_bytes", split).load(path)
        assert sorted((r["row"], r["col"], r["val"]) for r in table.collect()) == [(r, c, float(r - c)) for r, c in want]
        assert table.rdd.getNumPartitions() > 1 or split > 1000
    assert sorted((r["row"], r["col"]) for r in MM.read_lines(spark, str(tmp_path / "a.mtx")).collect()) == want


def test_size_line_that_looks_like_an_entry(spark, tmp_path):
    (tmp_path / "b.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 2\n2 2 2\n1 1 5\n")
    assert sorted(tuple(r)[:3] for r in MM.read_lines(spark, str(tmp_path / "b.mtx")).collect()) == [(0, 0, 5.0), (1, 1, 2.0)]
