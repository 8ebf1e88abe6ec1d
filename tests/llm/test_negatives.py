"""Hard negatives against all inner products."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import negatives

VEC = "vec_id long, embedding array<double>, label int, row string, score double, anchor int, d int"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90, factor=256.0):
    """rows (id, vector, label); anchor: which rows are."""
    able = [(i, [int(np.floor(factor * x)) for x in v], label, anchor(i)) for i, v, label in rows if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for k, (a, x, own, is_anchor) in enumerate(able):
        if not is_anchor:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), b, label) for j, (b, y, label, _) in enumerate(able) if j != k and len(y) == len(x)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for s, b, _ in [s for s in scored if s[2] == own][:positives]:
            found = [(n, c) for n, c, label in scored if label != own and low * s <= 100 * n <= high * s][:negatives]
            out.update((a, b, r + 1, c, s, n) for r, (n, c) in enumerate(found))
    return out


def told(df):
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0, 3, 4) for r in rows], VEC)


@pytest.mark.parametrize(("seed", "wave", "pivots"), [(1, 16384, 16), (2, 7, 4), (3, 5, 1)])
def test_against_all_products(spark, monkeypatch, seed, wave, pivots):
    """Crowds of copies, ties, negative and zero scores, few of a label; several waves, blocks and steps."""
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 32)
    monkeypatch.setattr(negatives, "STEP", 4)
    r = np.random.default_rng(seed)
    centre = r.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] + 0.4 * r.normal(size=8)).round(2).tolist(), int(i % 6 if i % 11 else r.integers(0, 6))) for i in range(300)]
    rows += [(300 + i, centre[0].tolist(), 0) for i in range(40)] + [(400 + i, (0.7 * centre[0]).tolist(), 1) for i in range(40)]
    rows += [(500, [0.0] * 8, 0), (501, [0.0] * 8, 1), (505, [0.0] * 8, 0), (510, [-1.0] * 8, 99), (515, [-1.0] * 8, 2)]
    got = told(negatives.mine(table(spark, rows).repartition(6), F.col("vec_id") % 5 == 0, wave=wave, pivots=pivots))
    want = brute(rows, lambda i: i % 5 == 0)
    assert got == want and sum(want.values()) > 500


def test_brackets_hold():
    r = np.random.default_rng(5)
    x, a = r.integers(-300, 300, (200, 16)).astype(float), r.integers(-300, 300, (20, 16)).astype(float)
    longest = float(max((x * x).sum(axis=1).max(), (a * a).sum(axis=1).max()))
    points = negatives.pivots_of(x[:50], longest, 8)
    d = negatives.distances(negatives.augmented(x, longest), points)
    own = negatives.Anchors(a, np.zeros(20), np.arange(20), negatives.distances(np.column_stack([a, np.zeros(20)]), points), longest)
    least, most = own.brackets(np.arange(20), d, d)
    assert (least <= a @ x.T).all() and (a @ x.T <= most).all()
    assert (most - least).min() < 0.5 * 2 * np.sqrt(longest * longest)


def test_odd(spark):
    bad = float("nan")
    rows = [(0, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (1, [0.5, 1.0], 2), (1, [0.5, 1.0], 2), (2, None, 1), (3, [1.0, None], 1), (4, [bad, 1.0], 2), (5, [float("inf"), 1.0], 2), (6, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (7, [], 2), (8, [1.0, 1.0, 1.0], 2), (200, [1.0, 1.0, 1.0], 1), (9, [1.0, 1.0, 0.5], 1)]
    got = told(negatives.mine(table(spark, rows), F.col("vec_id") % 100 == 0))
    want = brute(rows, lambda i: i is not None and i % 100 == 0)
    assert got == want and want
    assert negatives.mine(table(spark, rows).where("false"), F.lit(True)).count() == 0
    assert negatives.mine(table(spark, rows), F.lit(None)).count() == 0
    with pytest.raises(ValueError, match="too long"):
        negatives.mine(table(spark, [(0, [1e30, 1.0], 1)]), F.lit(True))
