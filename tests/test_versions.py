"""A graph in versions: whole before and after, whatever happens between."""

import json

import pytest

from lexigrove.sources import versions

NODE, EDGE = "id string, v int", "source string, target string, type string"


@pytest.fixture
def graph(spark, tmp_path):
    root = str(tmp_path / "g")
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(40)], NODE)
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "NEXT") for i in range(39)], EDGE)
    assert versions.create(root, nodes, edges, buckets=8) == 1
    return root


def delta(spark, **parts):
    empty = {f"{a}_{b}": spark.createDataFrame([], s) for b, s in (("nodes", NODE), ("edges", EDGE)) for a in ("added", "updated", "removed")}
    return empty | {k: spark.createDataFrame(v, NODE if k.endswith("nodes") else EDGE) for k, v in parts.items()}


def state(spark, root, version=None):
    return tuple(sorted(tuple(r) for r in df.collect()) for df in versions.read(spark, root, version))


def test_a_delta_makes_the_next_version(spark, graph):
    before = state(spark, graph)
    old = versions.read(spark, graph)[0]
    d = delta(spark, added_nodes=[("new", 1)], updated_nodes=[("n3", 33)], removed_nodes=[("n20", 20)], added_edges=[("new", "n5", "X")], removed_edges=[("n1", "n2", "NEXT")])
    assert versions.commit(spark, graph, d) == 2
    nodes, edges = state(spark, graph)
    assert set(nodes) == (set(before[0]) - {("n3", 3), ("n20", 20)}) | {("n3", 33), ("new", 1)}
    assert set(edges) == {e for e in before[1] if "n20" not in e[:2] and e[:2] != ("n1", "n2")} | {("new", "n5", "X")}
    assert state(spark, graph, 1) == before and sorted(tuple(r) for r in old.collect()) == before[0]


def test_buckets_without_changes_are_taken_over(spark, graph):
    versions.commit(spark, graph, delta(spark, updated_nodes=[("n3", 33)]))
    one, two = (json.load(open(f"{graph}/versions/{v}.json"))["tables"] for v in (1, 2))
    assert one["edges"] == two["edges"]
    assert sum(one["nodes"]["folders"][b] != f for b, f in two["nodes"]["folders"].items()) == 1


@pytest.mark.parametrize("at", ["edges", "manifest"])
def test_a_writer_that_dies_changes_nothing(spark, graph, monkeypatch, at):
    before = state(spark, graph)
    d = delta(spark, updated_nodes=[("n3", 33)], added_edges=[("n3", "n9", "X")])
    plain = versions._written

    def dies(*a, **k):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if at == "edges":  # the nodes are written
            m.setattr(versions, "_written", lambda df, root, table, *a: dies() if table == "edges" else plain(df, root, table, *a))
        else:
            m.setattr(versions, "_publish", dies)
        with pytest.raises(RuntimeError):
            versions.commit(spark, graph, d)
    assert versions.versions(spark, graph) == [1] and state(spark, graph) == before
    assert versions.commit(spark, graph, d) == 2 and ("n3", 33) in state(spark, graph)[0]


def test_the_second_writer_is_refused(spark, graph):
    versions.commit(spark, graph, delta(spark, updated_nodes=[("n3", 33)]), based_on=1)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, graph, delta(spark, updated_nodes=[("n3", 44)]), based_on=1)
    assert ("n3", 33) in state(spark, graph)[0] and versions.versions(spark, graph) == [1, 2]
    with pytest.raises(versions.Conflict):
        versions.create(graph, *versions.read(spark, graph))


def test_odd_cases(spark, graph, tmp_path):
    with pytest.raises(ValueError):  # an edge without a node at its end
        versions.commit(spark, graph, delta(spark, added_edges=[("n3", "nowhere", "X")]))
    with pytest.raises(ValueError):
        versions.read(spark, graph, 7)
    with pytest.raises(ValueError):
        versions.read(spark, str(tmp_path / "none"))
    assert versions.commit(spark, graph, delta(spark)) == 2 and state(spark, graph) == state(spark, graph, 1)
    assert versions.commit(spark, graph, delta(spark, removed_nodes=[(f"n{i}", i) for i in range(40)])) == 3
    assert state(spark, graph) == ([], [])
    assert versions.commit(spark, graph, delta(spark, added_nodes=[("a", 1)], added_edges=[("a", "a", "S")])) == 4
    assert state(spark, graph) == ([("a", 1)], [("a", "a", "S")])
