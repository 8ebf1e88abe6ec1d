"""Connected components of a graph given as links, without a driver-side union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Links (a, b) of longs to rows (node, root): root is the smallest node reachable from node.

    Contraction: every node points at the smallest node among itself and its neighbours, pointers are doubled twice,
    and the links are rewritten to the targets. Links inside a group vanish, so each round leaves a much smaller graph;
    a round costs joins on narrow rows and an aggregation with map-side minima, never a collected neighbour list.
    Nodes without links have no row. Self-links and repeated links are allowed; links with a null end count for nothing.
    """
    left = staged(
        links.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        f"{name}-links",
    )
    known = None
    while not left.isEmpty():
        near = (
            left.select(F.col("a").alias("node"), "b")
            .unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("b")))
            .groupBy("node")
            .agg(F.min("b").alias("near"))
            .select("node", F.least("node", "near").alias("to"))
        )
        first = near = staged(near, f"{name}-near")
        for _ in range(2):
            ahead = near.select(F.col("node").alias("to"), F.col("to").alias("next"))
            near = near.join(ahead, "to").select("node", F.col("next").alias("to"))
        near = staged(near, f"{name}-jumped")
        dropped(first)
        before = known
        if known is None:
            known = near
        else:
            moved = near.select(F.col("node").alias("to"), F.col("to").alias("next"))
            known = staged(known.join(moved, "to", "left").select("node", F.coalesce("next", "to").alias("to")), f"{name}-known")
        ends = [near.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab"]
        old, left = left, staged(
            left.join(ends[0], "a")
            .join(ends[1], "b")
            .where("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .distinct(),
            f"{name}-links",
        )
        dropped(old, before, None if known is near else near)
    if known is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = known.select("node", F.col("to").alias("root"))
    out.staged_path = known.staged_path
    return out
