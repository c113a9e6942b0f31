import random

import pytest

from pagelantern.llm.components import components


def union_find(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 2), (2, 5), (5, 2)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 200)], [(random.Random(k).randrange(80), random.Random(-k).randrange(80)) for k in range(1, 60)]])
def test_equal_union_find(frame, edges):
    got = {r.v: r.c for r in components(frame(edges, "a long, b long")).collect()}
    assert got == {v: c for v, c in union_find([e for e in edges if e[0] != e[1]]).items()}
