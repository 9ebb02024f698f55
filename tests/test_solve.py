"""Conjugate gradients against numpy's solver."""

import numpy as np
import pytest

from fillweave.operators import matrix as X
from fillweave.operators import solve


def test_against_numpy(spark):
    w = 4
    ids = np.arange(w * w).reshape(w, w)
    pairs = np.concatenate([np.stack([ids[:, :-1].ravel(), ids[:, 1:].ravel()]), np.stack([ids[:-1].ravel(), ids[1:].ravel()])], axis=1)
    both = np.concatenate([pairs, pairs[::-1]], axis=1).T.tolist()
    coo = X.grid_laplacian(spark.createDataFrame([(int(i),) for i in ids.ravel()], "v int"), spark.createDataFrame(both, "u int, v int"))
    dense = np.zeros((w * w, w * w))
    for r in coo.collect():
        dense[r["row"], r["col"]] = r["val"]
    b = np.sin(np.arange(w * w))
    got = solve.conjugate_gradient(coo, spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "idx int, val double"))
    x = np.array([v for _, v in sorted(map(tuple, got.x.collect()))])
    assert np.allclose(x, np.linalg.solve(dense, b), atol=1e-4)
    assert got.residual <= 1e-5 * np.linalg.norm(b) and got.steps <= w * w


def test_zero_right_side(spark):
    got = solve.conjugate_gradient(spark.createDataFrame([(0, 0, 2.0)], "row int, col int, val double"), spark.createDataFrame([(0, 0.0)], "idx int, val double"))
    assert got.steps == 0 and got.residual == pytest.approx(0)
