"""Plain graph measures to compare with."""

import itertools


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def _near(rows):
    near = {}
    for a, b, w in rows:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    return near


def _paths(near, s, t):
    """All shortest paths by exhaustive search."""
    best, found, stack = float("inf"), [], [(0.0, [s])]
    while stack:
        d, p = stack.pop()
        if d > best:
            continue
        if p[-1] == t:
            if d < best:
                best, found = d, []
            found.append(p)
            continue
        stack += [(d + w, [*p, u]) for u, w in near[p[-1]].items() if u not in p]
    return [p for p in found if sum(near[a][b] for a, b in itertools.pairwise(p)) == best]


def betweenness(rows):
    near = _near(rows)
    n, out = len(near), dict.fromkeys(near, 0.0)
    for s, t in itertools.permutations(near, 2):
        paths = _paths(near, s, t)
        for v in near:
            if v not in (s, t) and paths:
                out[v] += sum(v in p for p in paths) / len(paths)
    return {v: round(x / ((n - 1) * (n - 2)) if n > 2 else x, 9) for v, x in out.items()}


def cut_vertices(rows):
    near = _near(rows)

    def count(nodes):
        return len(set(components([(a, b) for a in nodes for b in near[a] if b in nodes]).values())) + sum(not (set(near[a]) & nodes) for a in nodes)

    whole = count(set(near))
    return {v for v in near if count(set(near) - {v}) > whole - (not near[v])}
