"""Cycles of a directed graph by name: strongly connected components, and one closed path in each.

Edges that no cycle can use go first: those from a node that nothing leads to, or to one that leads nowhere. A node that one
edge alone leads to is put into that edge's source, or over a few such nodes into the first that stays: who reaches whom is the
same for all other nodes, and the node lies on a cycle with it if an edge of its own, or of one behind it on that way, leads to
that component, which is looked up when it is taken back out. The same goes for nodes that one edge alone leaves. Of a chain
about a third is left after a turn, so rounds are as the logarithm of its length.
What is left, of which every node has two edges both ways, is coloured: every node takes the smallest node that it can be reached from. The nodes of a colour that lead back to the node
that gave it are one component; they go, and the rest is trimmed and coloured again. Each round is an aggregation on narrow
rows, written to the shared folder; nothing is collected. The rounds of a colouring are as many as its longest shortest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, staged


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges (source, target) without those that lie on no cycle because one of their ends is a dead end."""
    n, before = -1, edges
    while True:
        left = before.join(before.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        left = left.join(before.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        left = staged(left.select("source", "target"), "cycles-trimmed")
        count = left.count()
        if before is not edges:
            dropped(before)
        if count in (n, 0):
            return left
        n, before = count, left


def _spread(labels: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest label of a node and of all that lead to it. Only nodes that changed tell the next."""
    news = labels
    while True:
        told = edges.join(news.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("label").alias("told"))
        after = labels.join(told, "node", "left").select("node", F.least("label", "told").alias("label"), F.coalesce(F.col("told") < F.col("label"), F.lit(False)).alias("new"))
        after = staged(after, name)
        before, labels = labels, after.drop("new")
        dropped(before)
        news = after.where("new").drop("new")
        labels.staged_path = after.staged_path
        if news.isEmpty():
            return labels


def _onward(edges: DataFrame, source: str, target: str, turn: int) -> DataFrame:
    """(node, into, over): nodes that one edge alone leads to (or that one leaves, with the ends swapped), with where they go.

    One in four by hash stays, anew each turn; the others go on over those before them, `over`, to the first that stays, `into`.
    Whoever is further than nine steps from there stays for this turn, and so do those behind.
    """
    stays = F.pmod(F.xxhash64(F.col(target), F.lit(turn)), F.lit(4)) == 0
    one = edges.where(~stays).groupBy(F.col(target).alias("node")).agg(F.count("*").alias("n"), F.min(source).alias("into")).where("n = 1").select("node", "into", F.slice(F.array("into"), 1, 0).alias("over"))
    three = staged(_further(one, 2), "cycles-single")
    nine = _further(three, 2).join(three.select(F.col("node").alias("into"), F.lit(True).alias("more")), "into", "left")
    # a way that comes back to its node is a circle of which none stays: its smallest does
    circle = F.array_append("over", F.col("into"))
    nine = nine.withColumn("least", F.when(F.array_contains(circle, F.col("node")), F.array_min(circle)))
    nine = nine.where("(more is null and least is null) or least <> node")
    over = F.when(F.array_contains("over", F.col("least")), F.slice("over", F.lit(1), F.array_position("over", F.col("least")).cast("int") - 1)).otherwise(F.col("over"))
    out = staged(nine.select("node", F.coalesce("least", "into").alias("into"), over.alias("over")), "cycles-onward")
    dropped(three)
    return out


def _further(ways: DataFrame, n: int) -> DataFrame:
    """`ways` (node, into, over) gone on `n` times by the ways of where they lead."""
    more = ways.select(F.col("node").alias("into"), F.col("into").alias("next"), F.col("over").alias("__over"))
    found = ways
    for _ in range(n):
        over = F.when(F.col("next").isNotNull(), F.concat("over", F.array("into"), "__over")).otherwise(F.col("over"))
        found = found.join(more, "into", "left").select("node", F.coalesce("next", "into").alias("into"), over.alias("over"))
    return found


def _merged(edges: DataFrame, onward: DataFrame | None) -> DataFrame:
    """The edges with each node of `onward` put into where it goes, without loops and without those to or from dead ends."""
    if onward is not None:
        for end in ("source", "target"):
            edges = edges.join(onward.select(F.col("node").alias(end), "into"), end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
    edges = edges.where("source <> target").select("source", "target").distinct()
    alive = edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
    return staged(alive.select("source", "target"), "cycles-edges")


def _taken_back(known: DataFrame, onward: DataFrame, edges: DataFrame, near: str, far: str) -> DataFrame:
    """(node, component) of the nodes of `onward` from which an edge leads back to the component of where they went.

    Those that a node went over are on that way as well. An edge to another node of `onward` is one of those gone over.
    """
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    ways = onward.join(edges.select(F.col(near).alias("node"), F.col(far).alias("other")), "node")
    ways = ways.join(of("into"), "into", "left").join(of("other"), "other", "left")
    component = F.coalesce("into_component", "into")
    back = ways.where(component == F.coalesce("other_component", "other"))
    return staged(back.select(F.explode(F.concat(F.array("node"), "over")).alias("node"), component.alias("component")).distinct(), "cycles-taken-back")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that lie on a cycle; component is its smallest node.

    edges: (source, target); repeated edges count once, an edge from a node to itself is a cycle, null ends count for nothing.
    """
    loops = staged(edges.where("source is not null and target is not null").select("source", "target").distinct(), "cycles-edges")
    left, levels, idle, turn = _merged(loops, None), [], 0, 0
    n = left.count()
    while n and idle < 2:
        near, far = ("source", "target") if turn % 2 == 0 else ("target", "source")
        onward = _onward(left, near, far, turn)
        after = _merged(left, onward)
        levels.append((onward, left, near, far))
        left, before, n, turn = after, n, after.count(), turn + 1
        idle = 0 if n < before else idle + 1
    known = _coloured(left) if n else left.select(F.col("source").alias("node"), F.col("source").alias("component"))
    held = [known]
    for onward, there, near, far in reversed(levels):
        back = _taken_back(known, onward, there, near, far)
        held.append(back)
        known = known.unionByName(back)
    # a component is named by one of its nodes, which need not be a row yet, nor be the smallest
    named = known.unionByName(known.select(F.col("component").alias("node"), "component")).distinct()
    least = named.groupBy("component").agg(F.min("node").alias("least"))
    own = loops.where("source = target").select(F.col("source").alias("node"), F.col("source").alias("component"))
    found = own.unionByName(named.join(least, "component").select("node", F.col("least").alias("component")))
    out = staged(found.groupBy("node").agg(F.min("component").alias("component")), "cycles")
    dropped(loops, left, *held, *[t for level in levels for t in level[:2]])
    return out


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles of what contraction leaves, by colouring."""
    left, found, rounds = trimmed(edges), None, []
    while not left.isEmpty():
        nodes = left.select(F.col("source").alias("node")).unionByName(left.select(F.col("target").alias("node"))).distinct()
        colours = _spread(staged(nodes.select("node", F.col("node").alias("label")), "cycles-colours"), left, "cycles-colours")
        of = lambda c: colours.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: E731, B023
        inside = staged(left.join(of("source"), "source").join(of("target"), "target").where("source_label = target_label").select("source", "target", F.col("source_label").alias("component")), "cycles-inside")
        # who leads back to the node that gave the colour
        back = staged(colours.where("node = label").select("node", F.col("label").alias("component")), "cycles-back")
        new, reached = back, back
        while not new.isEmpty():
            step = inside.join(new.select(F.col("node").alias("target"), "component"), ["target", "component"]).select(F.col("source").alias("node"), "component").distinct()
            new = staged(step.join(reached.select("node"), "node", "left_anti"), "cycles-back")
            rounds.append(new)
            reached = reached.unionByName(new)
        # a node alone is on no cycle but its own loop
        many = reached.groupBy("component").count().where("count > 1").select("component")
        members = staged(reached.join(many, "component", "left_semi").select("node", "component"), "cycles-members")
        found = members if found is None else found.unionByName(members)
        gone = reached.select("node")
        before = left
        left = trimmed(left.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target"))
        dropped(before, colours, inside)
    dropped(left, *rounds)
    return found if found is not None else staged(edges.limit(0).select(F.col("source").alias("node"), F.col("source").alias("component")), "cycles-members")


def closed_paths(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, path): the shortest way from the smallest node of each component back to it, of equal ones the first.

    All components walk at once, one join a step; of the ways to a node the first is kept, so the rows are as many as nodes.
    """
    of = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    inside = edges.select("source", "target").distinct().join(of("source"), "source").join(of("target"), "target").where("source_component = target_component")
    inside = staged(inside.select("source", "target", F.col("source_component").alias("component")), "closed-inside")
    front = components.where("node = component").select("component", "node", F.array("node").alias("path"))
    seen, found, held = None, None, [inside]
    while True:
        step = inside.join(front.select(F.col("node").alias("source"), "path"), "source").select("component", F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        step = step.groupBy("component", "node").agg(F.min("path").alias("path"))
        step = staged(step if seen is None else step.join(seen, "node", "left_anti").select("component", "node", "path"), "closed-step")
        held.append(step)
        closed = step.where("node = component").select("component", "path")
        found = closed if found is None else found.unionByName(closed)
        if step.isEmpty():
            break
        front = step.join(closed.select("component"), "component", "left_anti")
        seen = step.select("node") if seen is None else seen.unionByName(step.select("node"))
    out = staged(found, "closed-paths")
    dropped(*held)
    return out
