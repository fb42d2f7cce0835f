"""Plain Python versions of cores, components and skylines, by definition."""

import itertools
import random


def random_graph(kind, seed, n=22, m=60, dims=3):
    """(edges in the model's columns with loops and duplicates, extra vertices)."""
    rng = random.Random(seed)
    pick = lambda: rng.randrange(n)
    if kind == "bipartite":
        return [(pick(), pick()) for _ in range(m)], []
    if kind == "directed":
        return [(pick(), pick()) for _ in range(m)] + [(1, 1), (2, 3), (2, 3)], [n + 5]
    return [(rng.randrange(dims), pick(), pick()) for _ in range(m)] + [(0, 4, 4), (1, 2, 3), (1, 3, 2)], [n + 5]


def neighbours(kind, edges, extra=(), dims=3):
    """(nbr[d][v], bound[v], links) with right vertices as ('V', id)."""
    if kind == "bipartite":
        dims = 2
    elif kind == "directed":
        dims = 2
    nbr = [{} for _ in range(dims)]
    bound, links = {}, set()
    for e in edges:
        if kind == "bipartite":
            u, v = ("U", e[0]), ("V", e[1])
            nbr[0].setdefault(u, set()).add(v)
            nbr[1].setdefault(v, set()).add(u)
            bound[u], bound[v] = {0}, {1}
            links.add((u, v))
        elif kind == "directed":
            s, d = e
            if s != d:
                nbr[0].setdefault(d, set()).add(s)
                nbr[1].setdefault(s, set()).add(d)
                bound[s] = bound[d] = {0, 1}
                links.add((s, d))
        else:
            layer, a, b = e
            if a != b:
                nbr[layer].setdefault(a, set()).add(b)
                nbr[layer].setdefault(b, set()).add(a)
                bound[a] = bound[b] = set(range(dims))
                links.add((a, b))
    for v in extra:
        bound.setdefault(v, set(range(dims)))
    return nbr, bound, links


def core(nbr, bound, t):
    alive = set(bound)
    while True:
        bad = {v for v in alive for d in bound[v] if len(nbr[d].get(v, set()) & alive) < t[d]}
        if not bad:
            return alive
        alive -= bad


def components(members, links):
    label = {v: v for v in members}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def all_cores(kind, nbr, bound):
    """{threshold: members} of every non-empty core."""
    base = 1 if kind == "bipartite" else 0
    top = [max((len(x) for x in d.values()), default=0) for d in nbr]
    out = {t: core(nbr, bound, t) for t in itertools.product(*(range(base, x + 1) for x in top))}
    return {t: m for t, m in out.items() if m}


def skyline(cores):
    by = {}
    for t, members in cores.items():
        for v in members:
            by.setdefault(v, set()).add(t)
    return {(t, v) for v, ts in by.items() for t in ts if not any(s != t and all(x >= y for x, y in zip(s, t)) for s in ts)}
