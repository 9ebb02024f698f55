"""Graph kernels against brute force."""

import numpy as np
import pytest

from fillweave.functions import kernels as K


def random_graph(n, m, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, n, m), rng.integers(0, n, m)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
    return np.concatenate([pairs[0], pairs[1]]), np.concatenate([pairs[1], pairs[0]])


def brute_fill(n, u, v):
    """Columns of the factor's pattern by eliminating vertex after vertex."""
    rows = [set() for _ in range(n)]
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        rows[a].add(b)
    counts, parent = [], []
    for k in range(n):
        above = {x for x in rows[k] if x > k}
        counts.append(1 + len(above))
        parent.append(min(above) if above else -1)
        for x in above:
            rows[x] |= above - {x}
    return counts, parent


@pytest.mark.parametrize("seed", range(12))
def test_tree_and_counts(seed):
    n = 5 + 4 * seed
    u, v = random_graph(n, 2 * n, seed)
    counts, parent = brute_fill(n, u, v)
    assert K.elimination_tree(n, u, v).tolist() == parent
    assert K.factor_counts(n, u, v).tolist() == counts


@pytest.mark.parametrize("seed", range(12))
def test_separator_parts_do_not_touch(seed):
    n = 10 + 7 * seed
    u, v = random_graph(n, n + 5, seed)
    side = K.level_separator(n, u, v)
    assert not (((side[u] == 0) & (side[v] == 1)).any())
    assert set(np.unique(side)) <= {0, 1, 2}


@pytest.mark.parametrize("seed", range(8))
def test_minimum_degree_takes_a_least_vertex_each_time(seed):
    n = 6 + 3 * seed
    u, v = random_graph(n, 2 * n, seed)
    order = K.minimum_degree(n, u, v).tolist()
    assert sorted(order) == list(range(n))
    rows = [set() for _ in range(n)]
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        rows[a].add(b)
    left = set(range(n))
    for x in order:
        least = min((len(rows[y]), y) for y in left)
        assert (len(rows[x]), x) == least
        left.discard(x)
        for y in rows[x]:
            rows[y] = (rows[y] | rows[x]) - {x, y}


def test_nested_dissection_is_a_permutation_of_less_fill():
    w = 24
    ids = np.arange(w * w).reshape(w, w)
    pairs = np.concatenate([np.stack([ids[:, :-1].ravel(), ids[:, 1:].ravel()]), np.stack([ids[:-1].ravel(), ids[1:].ravel()])], axis=1)
    u, v = np.concatenate([pairs[0], pairs[1]]), np.concatenate([pairs[1], pairs[0]])
    order = K.nested_dissection(w * w, u, v)
    assert sorted(order.tolist()) == list(range(w * w))
    place = np.argsort(order)
    assert K.factor_counts(w * w, place[u], place[v]).sum() < K.factor_counts(w * w, u, v).sum()


def test_edgeless():
    none = np.zeros(0, dtype=int)
    assert K.minimum_degree(3, none, none).tolist() == [0, 1, 2]
    assert K.elimination_tree(2, none, none).tolist() == [-1, -1]
