"""Strong components and closed paths of random graphs against a plain search."""

import random
from collections import defaultdict

from lexigrove.operators import cycles


def reach(edges, a):
    seen, left = set(), [a]
    while left:
        for t in edges[left.pop()]:
            if t not in seen:
                seen.add(t)
                left.append(t)
    return seen


def brute(pairs):
    edges = defaultdict(set)
    for s, t in pairs:
        edges[s].add(t)
    far = {n: reach(edges, n) for n in {x for p in pairs for x in p}}
    return {n: min(m for m in far[n] if n in far[m]) for n in far if n in far[n]}, edges


def test_random_graphs(spark):
    r = random.Random(4)
    pairs = [(100 * g + r.randrange(12), 100 * g + r.randrange(12)) for g in range(6) for _ in range(6 + 3 * g)]
    pairs += [(900 + i, 900 + (i + 1) % 9) for i in range(9)] + [(i, i + 100) for i in range(0, 400, 7)] + [(950, 950), (960, 961)] + pairs[:5]
    rows = spark.createDataFrame([*pairs, (None, 1), (1, None)], "source long, target long")
    found = cycles.strong_components(rows)
    want, edges = brute(pairs)
    assert {x.node: x.component for x in found.collect()} == want
    paths = {x.component: x.path for x in cycles.closed_paths(rows, found).collect()}
    assert set(paths) == set(want.values())
    for c, path in paths.items():
        assert path[0] == path[-1] == c and all(t in edges[s] and want[s] == c for s, t in zip(path, path[1:]))
        ways, n = {c}, 0
        while True:  # the length of the shortest way back
            n += 1
            ways = {t for s in ways for t in edges[s]}
            if c in ways:
                break
        assert len(path) == n + 1


def test_none(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "source string, target string")
    found = cycles.strong_components(rows)
    assert found.count() == 0 and cycles.closed_paths(rows, found).count() == 0
    assert cycles.strong_components(rows.where("false")).count() == 0


def test_few_rounds(spark, monkeypatch):
    """Rings in a row, a long ring and many pairs: a turn leaves about a third of a chain and nothing of a short ring."""
    pairs = [(6 * k + i, 6 * k + (i + 1) % 6) for k in range(40) for i in range(6)] + [(6 * k, 6 * k + 6) for k in range(39)]
    pairs += [(1000 + i, 1000 + (i + 1) % 100) for i in range(100)] + [(2000 + i, 2000 + (i ^ 1)) for i in range(200)]
    names, staged = [], cycles.staged
    monkeypatch.setattr(cycles, "staged", lambda df, name: names.append(name) or staged(df, name))
    found = {x.node: x.component for x in cycles.strong_components(spark.createDataFrame(pairs, "source long, target long")).collect()}
    assert found == brute(pairs)[0]
    assert len(names) <= 30, len(names)
