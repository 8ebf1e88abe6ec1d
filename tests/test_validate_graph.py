import pytest

from lexigrove.operators import graph, validate

NODES = "id string, type string, parent_id string, start_idx int, text string, number string, marker string, title string"


def nodes(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], NODES)


FIVE = [("root", "CHAPTER", None, 0, "x"), ("section-1", "SECTION", "root", 1, "x"), ("clause-1", "CLAUSE", "section-1", 2, "x"), ("clause-2", "CLAUSE", "section-1", 3, "x"), ("section-2", "SECTION", "root", 4, "x")]


def test_five_nodes(spark):
    e = graph.edges(nodes(spark, FIVE)).collect()
    kinds = [r.type for r in e]
    assert (kinds.count("BELONG_TO"), kinds.count("NEXT"), kinds.count("PREVIOUS"), len(e)) == (4, 2, 2, 8)
    assert all(r.source != r.target for r in e)
    n, _, meta = graph.build(nodes(spark, FIVE), "doc")
    assert meta.first().total_nodes == 5 and meta.first().total_edges == 8 and n.count() == 5


def test_each_rule(spark):
    def ids(df):
        return sorted(r.node_id for r in df.collect())

    assert ids(validate.duplicate_ids(nodes(spark, [*FIVE, ("root", "CHAPTER", None, 9)]))) == ["root"]
    assert ids(validate.orphans(nodes(spark, [("p", "POINT", None, 0)]))) == ["p"]
    assert ids(validate.broken_parents(nodes(spark, [("p", "POINT", "gone", 0)]))) == ["p"]
    assert ids(validate.cycles(nodes(spark, [("a", "CLAUSE", "b", 0), ("b", "CLAUSE", "a", 1), ("c", "POINT", "a", 2), ("s", "CLAUSE", "s", 3)]))) == ["a", "b", "s"]
    assert ids(validate.empty_nodes(nodes(spark, [("c", "CLAUSE", "a", 0, "  "), ("d", "ARTICLE", "a", 0, "")]))) == ["c"]
    assert ids(validate.bad_schema(nodes(spark, [(None, "CLAUSE", "a", 0), ("x", "CLAUSE", "a", 0)]))) == [None]


def gaps(spark, type_, marks):
    rows = [(f"n{i}", type_, "p", i, "x", None if type_ == "POINT" else m, m if type_ == "POINT" else None) for i, m in enumerate(marks)]
    return sorted(r.node_id for r in validate.sequence_gaps(nodes(spark, rows)).collect())


def test_sequences(spark):
    assert gaps(spark, "CLAUSE", ["1", "3"]) == ["clause_2"]
    assert gaps(spark, "POINT", ["a", "b", "d"]) == ["point_c"]
    assert gaps(spark, "POINT", ["d", "đ", "e"]) == []
    assert gaps(spark, "CHAPTER", ["I", "IV"]) == ["chapter_II", "chapter_III"]
    assert gaps(spark, "CLAUSE", ["5", "2"]) == []  # descending ends span nothing
    assert gaps(spark, "POINT", ["a", "w"]) == []
    assert gaps(spark, "CLAUSE", ["1"]) == []


def test_score_and_cascade(spark):
    four = [("root", "CHAPTER", None, 0, "x"), ("a", "ARTICLE", "root", 1, "x"), ("b", "ARTICLE", "root", 2, "x"), ("p", "POINT", None, 3, "x")]
    kept, issues, report = validate.validate(nodes(spark, four))
    assert report.first().structural_integrity_score == 75.0
    tree = [("root", "CHAPTER", None, 0, "x"), ("a", "ARTICLE", "root", 1, "x"), ("lost", "CLAUSE", "gone", 2, "x"), ("c1", "POINT", "lost", 3, "x"), ("c2", "POINT", "c1", 4, "x")]
    kept, issues, report = validate.validate(nodes(spark, tree))
    assert sorted(r.id for r in kept.collect()) == ["a", "root"]
    assert issues.where("severity = 'ERROR'").count() == 3
    kept, issues, report = validate.validate(nodes(spark, FIVE).where("false"))
    assert kept.count() == 0 and report.first().structural_integrity_score == 100.0


def test_cycle_of_edges(spark):
    e = lambda *x: spark.createDataFrame(list(x), "source string, target string")
    assert not validate.has_cycle(e(("child", "parent"), ("leaf", "child")))
    assert validate.has_cycle(e(("a", "b"), ("b", "a")))
    assert validate.has_cycle(e(("a", "a")))


def test_shapes_and_contract(spark):
    n = spark.createDataFrame([("a", "ARTICLE", "1", ["LegalNode"]), ("b", "CLAUSE", None, ["LegalNode"]), ("c", "ARTICLE", "x", [])], "id string, kind string, number string, labels array<string>")
    e = spark.createDataFrame([("b", "a", "BELONG_TO"), ("a", "b", "BELONG_TO"), ("a", "b", "NEXT"), ("a", "zz", "bad-type")], "source string, target string, type string")
    found = sorted((r.rule, r.source) for r in validate.shapes(n, e).collect())
    assert found == [("ARTICLE_NUMBER", "c"), ("MISSING_END", "a"), ("PAIR", "a"), ("SEQUENCE_LEVEL", "a")]
    rules = sorted(r.rule for r in validate.graph_contract(n, e).collect())
    assert rules == ["EDGE_TYPE", "MISSING_END", "NO_LABELS"]
    assert [tuple(r) for r in validate.orphan_edges(e, n).collect()] == [("a", "zz", ["zz"])]
    a = validate.audit(3, 5, n, e).first()
    assert not a.valid and a.orphans == 1
    with pytest.raises(ValueError):
        validate.require_empty(n, "rows")


def test_ancestors_and_context(spark):
    t = nodes(spark, [("ch", "CHAPTER", None, 0, "t0"), ("ar", "ARTICLE", "ch", 1, "t1"), ("cl", "CLAUSE", "ar", 2, "t2"), ("po", "POINT", "cl", 3, "t3")])
    assert {(r.ancestor, r.distance) for r in graph.ancestors(t).where("id = 'po'").collect()} == {("cl", 1), ("ar", 2), ("ch", 3)}
    assert {r.id: r.ancestor for r in graph.nearest_ancestor(t, "ARTICLE").collect()} == {"ar": "ar", "cl": "ar", "po": "ar"}
    c = {r.id: r.context for r in graph.context_path(t).collect()}
    assert c["po"] == "- ARTICLE: t1\n- CLAUSE: t2" and c["ch"] == ""


def test_attach_embeddings(spark):
    n = spark.createDataFrame([("p1",), ("p2",)], "id string")
    v = spark.createDataFrame([("p1", [1.0]), ("p2", [2.0])], "node_id string, embedding array<float>")
    assert graph.attach_embeddings(n, v).count() == 2
    with pytest.raises(ValueError):
        graph.attach_embeddings(n, v.where("node_id = 'p1'"))


def test_confidence(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([0.5, None, 0.5], 1.0), ([], 1.0), ([2.0], 0.5), ([0.9, 0.9], None)], "s array<double>, w double")
    assert [r[0] for r in df.select(graph.confidence(F.col("s"), F.col("w"))).collect()] == [0.75, 0.5, 0.5, 0.99]


def test_long_chains_and_rings(spark):
    """A chain of 3,000 edges has no cycle; closed, or beside a ring of any length, it has; few rounds for each."""
    e = lambda pairs: spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "source string, target string")
    chain = [(i, i + 1) for i in range(3000)]
    assert not validate.has_cycle(e(chain + [(0, 2000), (5, 700)]))
    assert validate.has_cycle(e([*chain, (3000, 0)]))
    for n in (2, 3, 7):
        assert validate.has_cycle(e(chain + [(f"r{i}", f"r{(i + 1) % n}") for i in range(n)] + [(3000, "r0")]))
    assert not validate.has_cycle(e([]))


def test_gaps_between_far_numbers(spark):
    rows = [("1", 0), ("3", 1), ("4000000000", 2)]
    n = spark.createDataFrame([(f"c{i}", "p", "CLAUSE", number, None, None, i) for number, i in rows], "id string, parent_id string, type string, number string, marker string, title string, start_idx int")
    assert sorted(r.node_id for r in validate.sequence_gaps(n).collect()) == ["clause_2", "clause_4..3999999999"]
