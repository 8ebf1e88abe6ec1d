"""Batched retrieval against scoring everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.functions import text as T
from lexigrove.operators import batch, retrieve


@pytest.fixture
def nodes(spark):
    """300 texts of 60 words, one of them in all texts, some texts twice."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        words = ["everywhere"] + [f"w{int(60 * rng.random() ** 3):02d}" for _ in range(int(rng.integers(3, 40)))]
        rows.append((f"law_dieu-{i % 40}_khoan-{i}", "", " ".join(words)))
    rows += [(a + "x", b, c) for a, b, c in rows[:20]] + [("none", "", None), ("blank", "", "!!")]
    return spark.createDataFrame(rows, "id string, title string, text string").cache()


@pytest.mark.parametrize("k", [1, 5, 150])
def test_lexical_equals_one_by_one(spark, nodes, tmp_path, k):
    """Thresholds lose nothing: with k beyond the impacts kept they are zero."""
    path = batch.impact_index(nodes, str(tmp_path / "i"), "1")
    asked = {1: ["everywhere", "w00", "w31"], 2: ["w59", "w58", "w01", "everywhere"], 3: ["everywhere"], 4: ["unknown"], 5: ["w05", "w05"], 6: [], 7: None}
    got = batch.bm25_many(spark, path, spark.createDataFrame(list(asked.items()), "question_id int, tokens array<string>"), k).collect()
    docs = nodes.select(F.col("id").alias("node_id"), T.lexical_tokens(F.concat_ws(" ", "title", "text")).alias("tokens")).where(F.size("tokens") > 0).cache()
    for q, tokens in asked.items():
        mine = [(r.node_id, round(r.score, 9)) for r in sorted((r for r in got if r.question_id == q), key=lambda r: r.place)]
        want = [(r.node_id, round(r.lexical_score, 9)) for r in retrieve.bm25(docs, tokens or [], k).collect()] if tokens else []
        assert sorted(x for _, x in mine) == sorted(x for _, x in want)
        last = min((x for _, x in want), default=0)
        assert {m for m in mine if m[1] > last} == {w for w in want if w[1] > last}


def test_common_tokens_bring_no_candidates(spark, nodes, tmp_path, monkeypatch):
    path = batch.impact_index(nodes, str(tmp_path / "i"), "1")
    kept = {}
    plain = batch.staged

    def watched(df, name):
        kept[name] = plain(df, name)
        return kept[name]

    monkeypatch.setattr(batch, "staged", watched)
    asked = spark.createDataFrame([(1, ["everywhere", "w55", "w50"])], "question_id int, tokens array<string>")
    assert batch.bm25_many(spark, path, asked, 2).count() == 2
    common = {r.token: r.common for r in kept["questions-tokens"].collect()}
    assert common["everywhere"] and not all(common.values())
    assert kept["questions-candidates"].count() < 100


def test_named_articles_are_found_without_tokens(spark, nodes, tmp_path):
    path = batch.impact_index(nodes, str(tmp_path / "i"), "1")
    questions = spark.createDataFrame([(1, "Theo Điều 7 và điều 7"), (2, "điều kiện"), (3, None)], "question_id int, question string")
    pairs = batch.named_articles(questions, nodes)
    assert {(r.question_id, r.node_id.split("_khoan")[0]) for r in pairs.collect()} == {(1, "law_dieu-7")}
    got = batch.bm25_many(spark, path, questions.withColumn("tokens", T.lexical_tokens("question")), 3, pairs).collect()
    assert [(r.question_id, r.score, r.place) for r in got] == [(1, 8.0, 1), (1, 8.0, 2), (1, 8.0, 3)]


def test_an_empty_corpus_and_no_questions(spark, nodes, tmp_path):
    empty = batch.impact_index(nodes.limit(0), str(tmp_path / "e"), "1")
    asked = spark.createDataFrame([(1, ["w01"])], "question_id int, tokens array<string>")
    assert batch.bm25_many(spark, empty, asked).count() == 0
    assert batch.bm25_many(spark, batch.impact_index(nodes, str(tmp_path / "i"), "1"), asked.limit(0)).count() == 0


def _crowds(n=1500, length=16):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, length))
    return centres[rng.integers(0, 12, n)] + rng.normal(size=(n, length)) * 0.4


def test_vectors_are_exact_and_cells_are_left_out(spark, tmp_path, monkeypatch):
    x = _crowds()
    x[7], x[9] = x[3], x[3] * 2  # ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [0.0] * 16), (5001, None), (5002, [float("nan")] * 16), (5003, [None] * 16)]
    df = spark.createDataFrame(rows, "node_id long, embedding array<double>")
    path = batch.vector_index(df, str(tmp_path / "v"), "1", cells=40)
    asked = df.where("node_id % 100 = 3 OR node_id >= 5000").withColumnRenamed("node_id", "question_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {q: np.lexsort((np.arange(len(x)), -np.round(unit @ unit[q], 12)))[:10].tolist() for q in range(3, len(x), 100)}
    read = []
    plain = batch._compared
    monkeypatch.setattr(batch, "_compared", lambda index, cells, pairs, k: read.append(pairs.count()) or plain(index, cells, pairs, k))

    def found(exact):
        out = {}
        for r in batch.vector_many(spark, path, asked, 10, probes=4, exact=exact).orderBy("question_id", "place").collect():
            out.setdefault(r.question_id, []).append(r.node_id)
        return out

    got = found(True)
    assert {q: set(v) for q, v in got.items()} == {q: set(v) for q, v in want.items()}
    assert got[3][0] == 3 and set(got[3][:3]) == {3, 7, 9}
    assert sum(read) < 0.7 * 40 * len(want)
    fast = found(False)
    assert np.mean([len(set(fast[q]) & set(want[q])) / 10 for q in want]) >= 0.95


def test_slices_of_hot_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batch, "BLOCK", 64)
    x = _crowds(400, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, embedding array<double>")
    path = batch.vector_index(df, str(tmp_path / "v"), "1", cells=2)
    got = batch.vector_many(spark, path, df.withColumnRenamed("node_id", "question_id"), 3, probes=1).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = -np.sort(-(unit @ unit.T), axis=1)[:, :3]
    assert len(got) == 1200 and all(abs(r.score - best[r.question_id, r.place - 1]) < 1e-9 for r in got)


def test_vectors_without_rows_or_of_two_lengths(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "node_id long, embedding array<double>")
    asked = df.withColumnRenamed("node_id", "question_id")
    with pytest.raises(ValueError):
        batch.vector_index(df, str(tmp_path / "two"), "1")
    empty = batch.vector_index(df.limit(0), str(tmp_path / "none"), "1")
    assert batch.vector_many(spark, empty, asked).count() == 0
    one = batch.vector_index(df.limit(1), str(tmp_path / "one"), "1")
    assert [(r.question_id, r.node_id) for r in batch.vector_many(spark, one, asked).collect()] == [(1, 1)]


def test_merged_by_question(spark):
    lexical = spark.createDataFrame([(1, f"l{i}", 10.0 - i, i + 1) for i in range(5)] + [(2, "a", 4.0, 1)], "question_id int, node_id string, score double, place int")
    vector = spark.createDataFrame([(1, "l1", 0.9, 1), (1, "v1", 0.8, 2), (2, "b", 0.7, 1), (3, "c", 0.6, 1)], "question_id int, node_id string, score double, place int")
    got = batch.merged_many(lexical, vector, 5).orderBy("question_id", "place").collect()
    assert [(r.question_id, r.node_id, r.retrieval_source) for r in got] == [(1, "l0", "LEXICAL"), (1, "l1", "LEXICAL"), (1, "l2", "LEXICAL"), (1, "l3", "LEXICAL"), (1, "v1", "VECTOR"), (2, "a", "LEXICAL"), (2, "b", "VECTOR"), (3, "c", "VECTOR")]


def test_few_candidates_of_many_hits(spark, tmp_path, monkeypatch):
    """Two hundred nodes hold a token of the question, ten hold both: only these are candidates."""
    seen, kept = {}, batch.staged
    monkeypatch.setattr(batch, "staged", lambda df, name: seen.setdefault(name, kept(df, name)))
    nodes = spark.createDataFrame([(i, "", "red ring" if i % 21 == 0 else "red rope" if i % 21 < 11 else "ring rope") for i in range(210)], "id long, title string, text string")
    path = batch.impact_index(nodes, str(tmp_path / "i"), "1")
    found = batch.bm25_many(spark, path, spark.createDataFrame([(1, ["red", "ring"])], "question_id long, tokens array<string>"), 10).collect()
    assert [r.node_id for r in sorted(found, key=lambda r: r.place)] == list(range(0, 210, 21))
    assert seen["questions-candidates"].count() == 10
