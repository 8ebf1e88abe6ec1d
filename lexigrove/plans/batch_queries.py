"""Registered queries that answer whole tables of questions in one plan, from indexes that are kept.

The SQL scores every question against every text or vector and knows nothing of thresholds, cells or probes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batch, route
from ..session import table
from .answer_queries import _BENCH, asked
from .graph_queries import LAW, law
from .queries import _TOKENS, query
from .source_queries import _folder

K = 10


def _tokens(column: str) -> str:
    return _TOKENS.replace("(text)", f"({column})")


#: BM25 of all pairs of d (id, tk) and q (qid, w), the impacts of a pair added in the order of tokens.
_ALL = """s AS (SELECT count(*) AS n, avg(len(tk)) AS al FROM d), w1 AS (SELECT id, len(tk) AS dl, unnest(tk) AS w FROM d), p AS (SELECT id, w, any_value(dl) AS dl, count(*) AS tf FROM w1 GROUP BY id, w), f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
im AS (SELECT id, w, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(1, al))) AS x FROM p JOIN f USING (w), s), sc AS (SELECT qid, id, sum(x ORDER BY w) AS score FROM q JOIN im USING (w) GROUP BY qid, id)"""


@query(f"""WITH d AS (SELECT doc_id AS id, {_tokens("text")} AS tk FROM documents WHERE len({_tokens("text")}) > 0), q AS (SELECT DISTINCT item_id AS qid, unnest({_tokens("text")}) AS w FROM benchmark), {_ALL}
SELECT qid AS question_id, id AS node_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS place FROM sc QUALIFY place <= {K}""")
def questions_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of each benchmark passage, by BM25."""
    nodes = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), "text")
    path = batch.impact_index(nodes, _folder(spark, "impacts"), route.content_hash(nodes, "text", "id"))
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), T.lexical_tokens("text").alias("tokens"))
    return batch.bm25_many(spark, path, questions, K).select("question_id", "node_id", F.round("score", 6).alias("score"), "place")


_NEAR = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT b.vec_id AS question_id, a.vec_id AS node_id, round({_NEAR}, 6) AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_NEAR} DESC, a.vec_id)::INT AS place FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0 QUALIFY place <= {K}")
def questions_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every fiftieth one, from a kept index of cells."""
    v = table(spark, sf, "embeddings")
    path = batch.vector_index(v, _folder(spark, "cells"), route.content_hash(v.withColumn("said", F.to_json("embedding")), "said", "vec_id"), id_col="vec_id")
    questions = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return batch.vector_many(spark, path, questions, K).select("question_id", "node_id", F.round("score", 6).alias("score"), "place")


_ANCHORS = f"""{LAW}, {_BENCH}, qs AS (SELECT qid, question || CASE WHEN qid % 3 = 0 THEN ' Điều ' || (qid % 5 + 1) ELSE '' END AS question FROM bq),
d AS (SELECT id, tk FROM (SELECT id, {_tokens("title || ' ' || text")} AS tk FROM law) WHERE len(tk) > 0), q AS (SELECT DISTINCT qid, unnest({_tokens("question")}) AS w FROM qs), {_ALL},
bo AS (SELECT qid, law.id, 8.0 AS extra FROM qs JOIN law ON list_contains(regexp_extract_all(lower(question), 'điều\\s+(\\d+)', 1), (k // 100)::VARCHAR)),
st AS (SELECT qid, id, coalesce(score, 0) + coalesce(extra, 0) AS score FROM sc FULL JOIN bo USING (qid, id)), lx AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM st QUALIFY place <= 5),
vl AS (SELECT law.id, embedding FROM law JOIN embeddings ON vec_id = k), vx AS (SELECT b.vec_id AS qid, a.id, {_NEAR} AS score, 4 + row_number() OVER (PARTITION BY b.vec_id ORDER BY {_NEAR} DESC, a.id) AS place FROM vl a JOIN embeddings b ON b.vec_id IN (SELECT qid FROM qs) QUALIFY place <= 9),
u AS (SELECT qid, id, score / max(score) OVER (PARTITION BY qid) AS score, 'LEXICAL' AS retrieval_source, place FROM lx UNION ALL SELECT qid, id, score, 'VECTOR', place FROM vx), u1 AS (SELECT * FROM u WHERE retrieval_source = 'VECTOR' OR place <= 4 QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY place) = 1),
an AS (SELECT qid, id, score, retrieval_source, row_number() OVER (PARTITION BY qid ORDER BY place)::INT AS place FROM u1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY place) <= 5)"""


def _anchors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(the statute, anchors of all questions): texts with the articles that the question names, then vectors."""
    nodes, v = law(spark, sf), table(spark, sf, "embeddings")
    i = F.col("question_id")
    questions = asked(spark, sf).withColumn("question", F.concat("question", F.when(i % 3 == 0, F.concat(F.lit(" Điều "), (i % 5 + 1).cast("string"))).otherwise("")))
    key = route.content_hash(nodes, "text", "id")
    texts = batch.impact_index(nodes, _folder(spark, "law-impacts"), key)
    lexical = batch.bm25_many(spark, texts, questions.select("question_id", T.lexical_tokens("question").alias("tokens")), 5, batch.named_articles(questions, nodes))
    placed = nodes.join(v.select(F.col("vec_id").alias("start_idx"), "embedding"), "start_idx").select(F.col("id").alias("node_id"), "embedding")
    cells = batch.vector_index(placed, _folder(spark, "law-cells"), key)
    vector = batch.vector_many(spark, cells, questions.select("question_id").join(v.select(F.col("vec_id").alias("question_id"), "embedding"), "question_id"), 5)
    return nodes, batch.merged_many(lexical, vector, 5)


@query(f"WITH {_ANCHORS} SELECT qid AS question_id, id AS node_id, round(score, 6) AS score, retrieval_source, place FROM an")
def questions_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Five anchors for each question about the statute."""
    return _anchors(spark, sf)[1].select("question_id", "node_id", F.round("score", 6).alias("score"), "retrieval_source", "place")


@query(f"""WITH RECURSIVE {_ANCHORS}, up AS (SELECT id, parent_id AS a, 1 AS g FROM law WHERE parent_id IS NOT NULL UNION ALL SELECT up.id, law.parent_id, g + 1 FROM up JOIN law ON law.id = up.a WHERE law.parent_id IS NOT NULL AND g < 3),
pa AS (SELECT qid, a AS id, min(g) AS g FROM an JOIN up USING (id) GROUP BY ALL), de AS (SELECT qid, up.id, min(g) AS g FROM an JOIN up ON up.a = an.id WHERE g <= 2 GROUP BY ALL)
SELECT qid AS question_id, 'PARENT' AS source_type, id, g AS graph_distance, row_number() OVER (PARTITION BY qid ORDER BY g, id)::INT AS place FROM pa QUALIFY place <= 24
UNION ALL SELECT qid, 'CHILD', de.id, g, row_number() OVER (PARTITION BY qid ORDER BY g, position, de.id)::INT AS place FROM de JOIN law ON law.id = de.id QUALIFY place <= 72""")
def questions_expanded(spark: SparkSession, sf: str) -> DataFrame:
    """What stands above and below the anchors of each question."""
    nodes, anchors = _anchors(spark, sf)
    named = lambda df, kind: df.select("question_id", F.lit(kind).alias("source_type"), "id", "graph_distance", "place")
    return named(batch.parents_many(nodes, anchors, 24), "PARENT").unionByName(named(batch.below_many(nodes, anchors, 2, 72), "CHILD"))
