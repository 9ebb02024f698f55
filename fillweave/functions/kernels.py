"""Small graph kernels for one region at a time, in numpy: they run inside grouped tasks."""

from __future__ import annotations

import heapq

import numpy as np


def csr(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each vertex's neighbours begin, and all neighbours."""
    order = np.lexsort((v, u))
    return np.searchsorted(u[order], np.arange(n + 1)), v[order]


def gathered(ptr: np.ndarray, adj: np.ndarray, front: np.ndarray) -> np.ndarray:
    """The neighbours of all vertices of a front, one after another."""
    n = ptr[front + 1] - ptr[front]
    return adj[np.repeat(ptr[front] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _levels(ptr: np.ndarray, adj: np.ndarray, root: int, depth: np.ndarray) -> list[np.ndarray]:
    """Breadth-first levels from root over vertices whose depth is -1; fills in their depth."""
    depth[root] = 0
    found, front = [np.array([root])], np.array([root])
    while True:
        near = gathered(ptr, adj, front)
        front = np.unique(near[depth[near] < 0])
        if not len(front):
            return found
        depth[front] = len(found)
        found.append(front)


def level_separator(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each vertex 0 (left), 1 (right) or 2 (separator); no edge joins left and right.

    The largest component is cut at the level that holds its median vertex, counted from an end
    found by two sweeps from its smallest vertex; other components go whole to the lighter side,
    larger ones first.
    """
    ptr, adj = csr(n, u, v)
    depth = np.full(n, -1)
    parts, ends = [], {}
    single = np.diff(ptr) == 0
    depth[single] = 0
    s = 0
    while s < n:
        if depth[s] < 0:
            found = _levels(ptr, adj, s, depth)
            parts.append(np.concatenate(found))
            ends[s] = int(found[-1].min())
            s += 1
        else:
            # the next vertex that no search has reached
            ahead = depth[s : s + 4096] < 0
            s += int(ahead.argmax()) if ahead.any() else len(ahead)
    parts = [(int(p.min()), p) for p in parts] + [(int(x), np.array([x])) for x in np.flatnonzero(single)]
    parts.sort(key=lambda p: (-len(p[1]), p[0]))
    parts, first = [p for _, p in parts], parts[0][0]
    side = np.zeros(n, dtype=np.int8)
    main = parts[0]
    # the search from the smallest vertex is the first sweep
    fresh = np.full(n, -1)
    start = int(_levels(ptr, adj, ends.get(first, first), fresh)[-1].min())
    fresh = np.full(n, -1)
    _levels(ptr, adj, start, fresh)
    d = fresh[main]
    cut = int(np.sort(d)[(len(d) - 1) // 2])
    side[main] = np.where(d < cut, 0, np.where(d > cut, 1, 2))
    weight = [int((d < cut).sum()), int((d > cut).sum())]
    for p in parts[1:]:
        light = int(weight[1] < weight[0])
        side[p] = light
        weight[light] += len(p)
    return side


def dissected(n: int, u: np.ndarray, v: np.ndarray, node: int, levels: int) -> np.ndarray:
    """The tree node of each vertex once the region at `node` is split by level separators down to `levels`; regions without edges stay."""
    at = np.full(n, node)
    regions = [(node, np.arange(n), u, v)]
    for _ in range((node + 1).bit_length() - 1, levels):
        lower = []
        for top, own, a, b in regions:
            if not len(a):
                continue
            side = level_separator(len(own), a, b)
            local = np.empty(len(own), dtype=np.int64)
            for s in (0, 1):
                mine = np.flatnonzero(side == s)
                local[mine] = np.arange(len(mine))
                inside = (side[a] == s) & (side[b] == s)
                lower.append((2 * top + 1 + s, own[mine], local[a[inside]], local[b[inside]]))
                at[own[mine]] = 2 * top + 1 + s
        regions = lower
    return at


def bisect(n: int, u: np.ndarray, v: np.ndarray, edge_weight: np.ndarray, weight: np.ndarray, starts: int = 4, least_share: float = 0.42) -> np.ndarray:
    """A side (0 or 1) for each vertex, with few weighted edges between sides of about equal weight.

    Breadth-first orders from several ends, cut at half the weight, are each improved by moves of
    single vertices; the best is taken.
    """
    order = np.lexsort((v, u))
    ptr, adj, ew = np.searchsorted(u[order], np.arange(n + 1)), v[order], edge_weight[order]
    total = weight.sum()
    best, best_cut, start = np.zeros(n, dtype=np.int8), None, 0
    for _ in range(starts):
        depth = np.full(n, -1)
        parts = [np.concatenate(_levels(ptr, adj, start, depth))]
        for s in range(n):
            if depth[s] < 0:
                parts.append(np.concatenate(_levels(ptr, adj, s, depth)))
        row = np.concatenate([parts[0], *sorted(parts[1:], key=lambda p: -len(p))])
        side = np.ones(n, dtype=np.int8)
        side[row[np.cumsum(weight[row]) - weight[row] / 2 <= total / 2]] = 0
        side = _improved(ptr, adj, ew, weight, side, least_share * total)
        cut = ew[side[np.repeat(np.arange(n), np.diff(ptr))] != side[adj]].sum()
        if best_cut is None or cut < best_cut:
            best, best_cut = side, cut
        start = int(parts[0][-1])  # the next order begins at this one's end
        if len(parts[0]) < n:
            start = int(max(parts, key=len)[-1])
    return best


def bisected(n: int, u: np.ndarray, v: np.ndarray, edge_weight: np.ndarray, weight: np.ndarray, splits: int) -> np.ndarray:
    """A part below 2**splits for each vertex: sides of bisect(), each of which is parted in two again."""
    side = bisect(n, u, v, edge_weight, weight).astype(np.int64)
    if splits == 1:
        return side
    part = side << (splits - 1)
    for s in (0, 1):
        own = np.flatnonzero(side == s)
        if not len(own):
            continue
        local = np.full(n, -1)
        local[own] = np.arange(len(own))
        inside = (side[u] == s) & (side[v] == s)
        part[own] += bisected(len(own), local[u[inside]], local[v[inside]], edge_weight[inside], weight[own], splits - 1)
    return part


def merged(n: int, u: np.ndarray, v: np.ndarray, edge_weight: np.ndarray, weight: np.ndarray, most: float) -> np.ndarray:
    """For each vertex the smallest one of its group; groups grow along heavy edges between light ones and weigh at most `most`.

    In each round the groups merge that want each other; ties go by a hash of the pair.
    """
    name, size, wanted = np.arange(n), weight.copy(), np.full(n, -1)
    turn = 0
    while True:
        turn += 1
        some = (u != v) & (size[u] + size[v] <= most)
        u, v, edge_weight = u[some], v[some], edge_weight[some]
        if not len(u):
            return name
        tie = (np.minimum(u, v) * 7919 + np.maximum(u, v) * 104_729 + 15_485_863 * turn) % 1_000_003
        order = np.lexsort((v, tie * (tie + 31) % 1_000_003, edge_weight**2 / (size[u] * size[v]), u))
        x = order[np.append(u[order][1:] != u[order][:-1], True)]
        wanted[u[x]] = v[x]
        a = u[x][(wanted[v[x]] == u[x]) & (u[x] < v[x])]
        if not len(a):
            return name
        up = np.arange(n)
        up[wanted[a]] = a
        size[a] += size[wanted[a]]
        name = up[name]
        pair, at = np.unique(up[u] * n + up[v], return_inverse=True)
        edge_weight, u, v = np.bincount(at, weights=edge_weight), pair // n, pair % n


def _improved(ptr: np.ndarray, adj: np.ndarray, ew: np.ndarray, weight: np.ndarray, side: np.ndarray, least: float, passes: int = 8) -> np.ndarray:
    """Sides after moves of the vertex of highest gain, each vertex once a pass; a pass ends at its best state."""
    n = len(weight)
    for _ in range(passes):
        far = side[np.repeat(np.arange(n), np.diff(ptr))] != side[adj]
        owner = np.repeat(np.arange(n), np.diff(ptr))
        gain = np.bincount(owner, weights=np.where(far, ew, -ew), minlength=n)
        share = [weight[side == 0].sum(), weight[side == 1].sum()]
        border = np.unique(owner[far])
        heap = [(-gain[x], int(x)) for x in border]
        heapq.heapify(heap)
        moved, won, best, best_at = [], 0.0, 0.0, 0
        done = np.zeros(n, dtype=bool)
        trial = side.copy()
        while heap and len(moved) - best_at < 50 + n // 20:
            g, x = heapq.heappop(heap)
            if done[x] or -g != gain[x]:
                continue
            a = trial[x]
            if share[a] - weight[x] < min(least, share[1 - a]):
                continue
            done[x] = True
            moved.append(x)
            won += gain[x]
            trial[x] = 1 - a
            share[a] -= weight[x]
            share[1 - a] += weight[x]
            for y, w in zip(adj[ptr[x] : ptr[x + 1]].tolist(), ew[ptr[x] : ptr[x + 1]].tolist(), strict=True):
                gain[y] += -2 * w if trial[y] == trial[x] else 2 * w
                if not done[y]:
                    heapq.heappush(heap, (-gain[y], y))
            gain[x] = -gain[x]
            if won > best:
                best, best_at = won, len(moved)
        if not best_at:
            break
        side[moved[:best_at]] = 1 - side[moved[:best_at]]
    return side


def minimum_degree(n: int, u: np.ndarray, v: np.ndarray, groups: list[np.ndarray] = ()) -> np.ndarray:
    """An elimination order by minimum degree, ties by id, on the quotient graph.

    Each of the groups is a clique that earlier eliminations left behind.
    """
    ptr, adj = csr(n, u, v)
    plain = [set(adj[ptr[i] : ptr[i + 1]].tolist()) for i in range(n)]
    cliques: list[set[int]] = [set() for _ in range(n)]
    members: dict[int, set[int]] = {n + k: set(g.tolist()) for k, g in enumerate(groups)}
    for k, group in members.items():
        for y in group:
            cliques[y].add(k)
    degree = [len(plain[i].union(*(members[c] for c in cliques[i])) - {i}) for i in range(n)]
    heap = [(degree[i], i) for i in range(n)]
    heapq.heapify(heap)
    done = np.zeros(n, dtype=bool)
    order = []
    while heap:
        d, x = heapq.heappop(heap)
        if done[x] or d != degree[x]:
            continue
        done[x] = True
        order.append(x)
        reach = set(plain[x])
        for c in cliques[x]:
            reach |= members[c]
        reach.discard(x)
        absorbed = cliques[x]
        members[x] = reach
        for y in reach:
            plain[y] -= reach
            plain[y].discard(x)
            cliques[y] -= absorbed
            cliques[y].add(x)
        for c in absorbed:
            members.pop(c, None)
        for y in reach:
            near = set(plain[y])
            for c in cliques[y]:
                near |= members[c]
            degree[y] = len(near) - (y in near)
            heapq.heappush(heap, (degree[y], y))
    return np.array(order, dtype=np.int64)


def eliminated_inside(n: int, u: np.ndarray, v: np.ndarray, groups: list[np.ndarray], free: np.ndarray) -> tuple[list[int], list[set[int]], dict[int, set[int]]]:
    """(order, plain, members): the free vertices of a quotient graph eliminated by minimum degree, and what is left of the graph.

    A degree counts what two elements share outside the newest one twice, so that no union of elements
    is formed. Elements that a new one covers go, as do at once free vertices that are in it alone. plain
    are the neighbours of each vertex, members those of each element: n + k is the k-th of the groups, else it
    is the eliminated vertex.
    """
    ptr, adj = csr(n, u, v)
    plain = [set(adj[ptr[i] : ptr[i + 1]].tolist()) for i in range(n)]
    members = {n + k: set(g.tolist()) for k, g in enumerate(groups)}
    cliques: list[set[int]] = [set() for _ in range(n)]
    for k, group in members.items():
        for y in group:
            cliques[y].add(k)
    free = free.tolist()
    degree = [len(plain[i]) + sum(len(members[c]) - 1 for c in cliques[i]) for i in range(n)]
    heap = [(degree[i], i) for i in range(n) if free[i]]
    heapq.heapify(heap)
    order = []
    while heap:
        d, x = heapq.heappop(heap)
        if not free[x] or d != degree[x]:
            continue
        free[x] = False
        order.append(x)
        absorbed, reach = cliques[x], plain[x]
        for c in absorbed:
            reach |= members.pop(c)
        reach.discard(x)
        plain[x], cliques[x] = set(), set()
        outside: dict[int, int] = {}
        for y in reach:
            cliques[y] -= absorbed
            for c in cliques[y]:
                outside[c] = outside.get(c, len(members[c])) - 1
        covered = {c for c, k in outside.items() if not k}
        for c in covered:
            del members[c]
        also = []
        for y in reach:
            if plain[y]:
                plain[y].discard(x)
                plain[y] = plain[y] - reach
            if covered:
                cliques[y] -= covered
            if free[y]:
                if plain[y] or cliques[y]:
                    degree[y] = len(plain[y]) + len(reach) - 1 + sum(outside[c] for c in cliques[y])
                    heapq.heappush(heap, (degree[y], y))
                else:
                    also.append(y)
            cliques[y].add(x)
        for y in sorted(also):
            free[y] = False
            order.append(y)
            cliques[y] = set()
        members[x] = reach.difference(also)
    return order, plain, members


def _quick_degree(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """An order by minimum degree with degrees that count double, which takes a third of the time."""
    return np.array(eliminated_inside(n, u, v, [], np.ones(n, dtype=bool))[0], dtype=np.int64)


def nested_dissection(n: int, u: np.ndarray, v: np.ndarray, small: int = 512) -> np.ndarray:
    """An order by recursive separators; pieces of at most `small` vertices by minimum degree."""
    if n <= small or not len(u):
        return _quick_degree(n, u, v)
    side = level_separator(n, u, v)
    if not (side == 0).any() or not (side == 1).any():
        return _quick_degree(n, u, v)
    out = []
    for s in (0, 1, 2):
        ids = np.flatnonzero(side == s)
        local = np.full(n, -1)
        local[ids] = np.arange(len(ids))
        inside = (side[u] == s) & (side[v] == s)
        piece = nested_dissection if s < 2 else _quick_degree
        out.append(ids[piece(len(ids), local[u[inside]], local[v[inside]])])
    return np.concatenate(out)


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest vertex of each one's component."""
    name = np.arange(n)
    while len(u):
        least = np.minimum(name[u], name[v])
        np.minimum.at(name, name[u], least)
        np.minimum.at(name, name[v], least)
        while (name[name] != name).any():
            name = name[name]
        apart = name[u] != name[v]
        u, v = u[apart], v[apart]
    return name


def forest_postorder(parent: list[int], own: int) -> tuple[list[int], list[int]]:
    """Vertices below `own` in post-order of the forest whose parents these are, and the place of each one's first descendant.

    Parents from `own` on, or -1, end a tree.
    """
    below: list[list[int]] = [[] for _ in range(own)]
    roots = []
    for x in range(own):
        (below[parent[x]] if 0 <= parent[x] < own else roots).append(x)
    order, first = [], [0] * own
    for root in roots:
        stack = [(root, iter(below[root]))]
        first[root] = len(order)
        while stack:
            x, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                stack.pop()
                order.append(x)
            else:
                first[child] = len(order)
                stack.append((child, iter(below[child])))
    return order, first


def factor_columns(n: int, u: np.ndarray, v: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Parents in the elimination tree (-1 for roots) and entries, the diagonal included, of the first `own` columns.

    Later vertices count as rows only; every edge needs an end among the first. Row k's entries are
    the tree paths up to k from its neighbours. Those of them that begin such a path (no other
    neighbour is below them) each add one to all columns above them, the lowest common ancestor
    of one and the next takes back what both add, and a row's own path ends at it. So columns are
    sums over subtrees, and no entry of the factor is visited.
    """
    ptr, adj = csr(n, u, v)
    near = [adj[ptr[k] : ptr[k + 1]].tolist() for k in range(n)]
    parent, jump = [-1] * n, [-1] * n
    for k in range(n):
        for i in near[k]:
            while i != -1 and i < k and i < own:
                after = jump[i]
                jump[i] = k
                if after == -1:
                    parent[i] = k
                i = after
    order, first = forest_postorder(parent, own)
    weight, up = [0] * own, list(range(own))
    seen, last = [-1] * n, [-1] * n  # of each row: the furthest start of a subtree that was met, and the path's begin met last
    open_ = [True] * own
    for place, x in enumerate(order):
        above = parent[x]
        if first[x] == place:
            weight[x] += 1  # a leaf begins its own row's path
        if 0 <= above < own:
            weight[above] -= 1
        for k in near[x]:
            if k > x and first[x] > seen[k]:
                weight[x] += 1
                before, last[k], seen[k] = last[k], x, place
                if before >= 0:
                    top = before
                    while up[top] != top:
                        up[top] = up[up[top]]
                        top = up[top]
                    if open_[top]:
                        weight[top] -= 1
        open_[x] = False
        if 0 <= above < own:
            up[x] = above
    for x in order:
        if 0 <= parent[x] < own:
            weight[parent[x]] += weight[x]
    return np.array(parent[:own], dtype=np.int64), np.array(weight, dtype=np.int64)


def elimination_tree(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The parent of each vertex in the elimination tree of a symmetric pattern, -1 for roots."""
    return factor_columns(n, u, v, n)[0]


def factor_counts(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Entries of each column of the Cholesky factor, the diagonal included."""
    return factor_columns(n, u, v, n)[1]
