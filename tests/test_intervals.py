"""Set algebra of intervals against sets of numbers, and holes however long."""

import random

from lexigrove.operators import validate

GAP = "parent_id string, type string, number long, marker string, title string, start_idx long"


def test_difference(spark):
    r = random.Random(2)
    rows = lambda: [(k, a, a + r.randrange(-1, 9)) for k in "xyz" for a in (r.randrange(40) for _ in range(8))]
    left, right = rows(), [x for x in rows() if x[0] != "z"]
    table = lambda x: spark.createDataFrame(x, "k string, low long, high long")
    got = validate.interval_difference(table(left), table(right), ["k"]).collect()
    numbers = lambda x: {(k, n) for k, a, b in x for n in range(a, b + 1)}
    assert numbers([tuple(x) for x in got]) == numbers(left) - numbers(right)
    assert not numbers([tuple(x) for x in got]) & {(x.k, x.high + 1) for x in got}  # none touches another
    assert validate.interval_difference(table([]), table(left), ["k"]).count() == 0
    huge = validate.interval_difference(table([("x", 1, 3 * 10**9)]), table([("x", 10**9, 2 * 10**9)]), ["k"]).collect()
    assert sorted((x.low, x.high) for x in huge) == [(1, 10**9 - 1), (2 * 10**9 + 1, 3 * 10**9)]


def test_holes(spark):
    rows = [("a", "CLAUSE", n, None, "", i) for i, n in enumerate((1, 2, 10**9, 10**9, 3 * 10**9))] + [("b", "CLAUSE", 5, None, "", 9), ("b", "CLAUSE", 1, None, "", 10), (None, "POINT", None, "a", "", 1), (None, "POINT", None, "đ", "", 2)]
    nodes = spark.createDataFrame(rows, GAP)
    got = sorted((x.parent_id or "", x.type, x.low, x.high) for x in validate.gap_intervals(nodes).collect())
    assert got == [("", "POINT", 2, 4), ("a", "CLAUSE", 3, 10**9 - 1), ("a", "CLAUSE", 10**9 + 1, 3 * 10**9 - 1)]
    assert validate.sequence_gaps(nodes).count() == 3 + 2 and validate.sequence_gaps(nodes, most_named=2).count() == 1 + 2
