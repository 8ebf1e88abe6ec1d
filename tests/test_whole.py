"""Results that are whole at every size: deep trees, long results, contexts beyond their bound."""

from lexigrove.operators import graph


def _chain(spark, n):
    return spark.createDataFrame([(i, i - 1 if i else None, "CHAPTER" if i == 0 else "POINT") for i in range(n)], "id long, parent_id long, type string")


def test_ancestors_of_deep_trees(spark):
    got = {tuple(r) for r in graph.ancestors(_chain(spark, 12)).collect()}
    assert got == {(i, k, i - k) for i in range(12) for k in range(i)}
    assert {tuple(r) for r in graph.ancestors(_chain(spark, 12), 2).collect()} == {(i, k, i - k) for i in range(12) for k in range(i) if i - k <= 2}


def test_ancestors_in_a_circle_end(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id long, parent_id long")
    got = {tuple(r) for r in graph.ancestors(nodes).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (1, 1, 3), (2, 3, 1), (2, 1, 2), (2, 2, 3), (3, 1, 1), (3, 2, 2), (3, 3, 3), (4, 1, 1), (4, 2, 2), (4, 3, 3)}


def test_branches_of_deep_trees_are_not_broken(spark):
    from lexigrove.operators import probes

    assert probes.broken_branches(_chain(spark, 12)).count() == 0
    assert probes.broken_branches(_chain(spark, 12).where("id <> 3")).count() == 8


def test_all_scores_of_an_index(spark, tmp_path):
    from lexigrove.operators import retrieve

    nodes = spark.createDataFrame([(i, "red", "ring") for i in range(25)], "id long, title string, text string")
    retrieve.lexical_index(nodes, str(tmp_path), "k")
    assert retrieve.bm25_indexed(spark, str(tmp_path), ["red"], k=None).count() == 25
    assert retrieve.bm25_indexed(spark, str(tmp_path), ["red"], k=7).count() == 7


def test_all_scores_of_changed_postings(spark, tmp_path):
    from lexigrove.operators import postings

    nodes = spark.createDataFrame([(i, "red", "ring") for i in range(25)], "id long, title string, text string")
    postings.create(nodes, str(tmp_path), parts=4)
    postings.change(spark, str(tmp_path), nodes.where("id = 1"), nodes.where("id = 2").select("id"))
    assert postings.top(spark, str(tmp_path), ["red"], k=None).count() == 24
    assert postings.top(spark, str(tmp_path), ["red"], k=7).count() == 7


def test_contexts_beyond_their_bound_tell_their_size(spark):
    from lexigrove.operators import retrieve

    rows = spark.createDataFrame([(str(i), "ALLOW", ["s"], ["a"], [], [], [], [], "e", "c", i) for i in range(300)], "norm_id string, modality string, subjects array<string>, actions array<string>, objects array<string>, conditions array<string>, exceptions array<string>, consequences array<string>, evidence string, citation string, place int")
    whole = retrieve.assemble_norms(rows, 1_000_000, sized=True).first()
    assert whole["whole"] == len(whole["context"]) > 400
    cut = retrieve.assemble_norms(rows, 400, sized=True).first()
    assert cut["whole"] == whole["whole"] and cut["context"] == whole["context"][: 400 - len(retrieve.CUT_MARK)].rstrip() + retrieve.CUT_MARK


def test_vague_texts_may_be_a_table(spark):
    from lexigrove.operators import ontology

    m = spark.createDataFrame([("1", "this", "e", "VALID"), ("2", "that", "e", "VALID"), ("3", "this", " ", "VALID")], "mention_id string, text string, evidence string, status string")
    r = spark.createDataFrame([], "source_id string, target_id string, relation_type string")
    by_table, by_list = (ontology.gate(m, r, v)[0].orderBy("mention_id").collect() for v in (spark.createDataFrame([("this",), ("this",)], "text string"), ["this"]))
    assert by_table == by_list and [x["status"] for x in by_table] == ["UNRESOLVED", "VALID", "QUARANTINED"]


def test_components_of_long_chains(spark):
    """Forty rings one after the other, dead ends on both sides: few jobs, right names."""
    from lexigrove.operators import cycles

    e = [(4 * k + i, 4 * k + (i + 1) % 4) for k in range(40) for i in range(4)] + [(4 * k + 2, 4 * k + 4) for k in range(39)] + [(-i - 1, -i) for i in range(30)] + [(158, 500)] + [(500 + i, 501 + i) for i in range(30)] + [(900, 900)]
    got = {tuple(r) for r in cycles.strong_components(spark.createDataFrame(e, "source long, target long")).collect()}
    assert got == {(4 * k + i, 4 * k) for k in range(40) for i in range(4)} | {(900, 900)}


def test_closed_paths_of_long_chains(spark):
    from lexigrove.operators import cycles

    e = spark.createDataFrame([(4 * k + i, 4 * k + (i + 1) % 4) for k in range(12) for i in range(4)] + [(4 * k + 2, 4 * k + 4) for k in range(11)], "source long, target long")
    got = {tuple(r) for r in cycles.closed_paths(e, cycles.strong_components(e)).selectExpr("component", "array_join(transform(path, x -> cast(x as string)), ' ')").collect()}
    assert got == {(4 * k, f"{4 * k} {4 * k + 1} {4 * k + 2} {4 * k + 3} {4 * k}") for k in range(12)}


def test_questions_are_read_once(spark):
    """The questions are a table of their own; their profiles are not columns of each text."""
    from lexigrove.plans import answer_queries

    texts = spark.createDataFrame([(1, "đất"), (2, "")], "id long, text string")
    found = answer_queries._scores(texts, "id")
    assert found.count() == 2 * len(answer_queries.ASKED)
    assert "NestedLoopJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_texts_reach_python_by_rows(spark):
    """A worker holds a hundred whole texts at a time, not an Arrow batch of 10,000."""
    from lexigrove.functions import text as T

    rows = spark.createDataFrame([("É Đ đường",), ("plain",), ("",), (None,)], "t string")
    found = rows.select(T.is_nfc("t").alias("is"), T.fold("t").alias("folded"), T.fold_keeping_d("t").alias("kept"), T.nfc_changes("t").alias("c"))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["is"], r.folded, r.kept, r.c.text, r.c.changed) for r in found.collect()] == [(False, "e d duong", "e đ đuong", "É Đ đường", 10), (True, "plain", "plain", "plain", 0), (True, "", "", "", 0), (None, None, None, None, 0)]


def test_cycles_are_not_broadcast(spark, monkeypatch):
    """The pointers of a round are joined by a shuffle: no table goes through the driver."""
    from lexigrove.operators import validate

    plans, kept = [], validate.staged
    monkeypatch.setattr(validate, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id long, parent_id long")
    assert {r.id for r in validate.on_cycles(nodes).collect()} == {1, 2, 3}
    assert len(plans) > 1 and not any("BroadcastHashJoin" in p for p in plans)


def test_long_norm_contexts_are_whole(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lexigrove.operators import retrieve
    from lexigrove.plans.queries import ORACLES, QUERIES

    from .oracle import same

    monkeypatch.setattr(retrieve, "SECTIONS", 300, raising=False)
    n = range(3000)
    pq.write_table(pa.table({"l_suppkey": [i % 1500 for i in n], "l_partkey": [(i * 7) % 400 for i in n], "l_returnflag": ["ARN"[i % 3] for i in n], "l_linestatus": ["OF"[i % 2] for i in n]}), tmp_path / "lineitem.parquet")
    found = QUERIES["norm_context"](spark, str(tmp_path))
    assert len(found.first()["context"]) > 100_000
    same(found, str(tmp_path), ORACLES["norm_context"])
