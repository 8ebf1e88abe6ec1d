"""Retrieval for whole tables of questions: one plan for all of them, keyed by question, over indexes that are kept.

Lexical: postings carry their impact, the share of BM25 that they give. A question's threshold is the k-th largest impact
of any one of its tokens; a posting that cannot reach it with the best impacts of the other tokens is left out, and tokens
that cannot reach it together ("common" ones) bring no candidates, they are looked up for those that the others brought.
The sums of the others give a
higher threshold, and few candidates are left to look up. So a token that is in every document is read once, not once a question. The result is that of scoring everything.

Vectors: an inverted file of cells around centroids. The first probes give each question a k-th score; cells whose
nearest possible vector is below it are never read, all others are, so the result is exact as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import dropped, partitions, staged
from .retrieve import ARTICLE_BOOST, K1, B, lexical_index
from .route import cached

#: Impacts of a token that are kept beside it: thresholds are known for up to so many results.
KEPT_IMPACTS = 100
#: Postings that a task adds up.
HITS = 500_000
#: Less than this apart, a sum of impacts counts as equal to a threshold.
SLACK = 1e-9


def _foldered(df: DataFrame, path: str, folder: str) -> None:
    """Rows in folders by a column; their schema stands beside them, since a table without rows has no folder to read it from."""
    df.limit(0).write.mode("overwrite").parquet(f"{path}-schema")
    df.write.mode("overwrite").partitionBy(folder).parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}-schema").schema).parquet(path)


def _impact(idf: Column, k1: Column, b: Column, avg_n: float | None) -> Column:
    """The share of BM25 of a posting (tf, n)."""
    tf = F.col("tf")
    return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("n") / max(1.0, avg_n or 0.0)))


def impact_index(nodes: DataFrame, path: str, key: str, parts: int = 64, k1: float = K1, b: float = B) -> str:
    """A `lexical_index` of nodes (id, title, text) and, by token, its weight (idf) and the largest impacts of its postings.

    The impact of a posting follows from its counts and its token's weight, so there is no table of impacts. Made anew for
    another `key`.
    """
    spark = nodes.sparkSession
    lexical_index(nodes, path, key, parts)

    def tokens() -> DataFrame:
        s = spark.read.parquet(f"{path}/lengths/data").first()  # one row
        postings = spark.read.schema(f"token string, node_id {nodes.schema['id'].dataType.simpleString()}, tf long, n int, part int").parquet(f"{path}/postings")
        postings.limit(0).write.mode("overwrite").parquet(f"{path}/postings-schema")
        df = postings.groupBy("token").agg(F.count("*").alias("df"))
        share = _impact(F.lit(1.0), F.lit(float(k1)), F.lit(float(b)), s["avg_n"])
        place = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("share")))
        best = postings.select("token", share.alias("share")).withColumn("place", place).where(F.col("place") <= KEPT_IMPACTS)
        idf = F.log(1 + (s["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        told = best.groupBy("token").agg(F.sort_array(F.collect_list("share"), False).alias("shares")).join(df, "token").withColumn("idf", idf)
        return told.select("token", "idf", F.transform("shares", lambda x: F.col("idf") * x).alias("best"), F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"))

    cached(f"{path}/tokens", key, tokens, spark)
    return path


def bm25_many(spark: SparkSession, path: str, questions: DataFrame, k: int = 10, boosted: DataFrame | None = None, boost: float = ARTICLE_BOOST) -> DataFrame:
    """(question_id, node_id, score, place): the k best nodes of each question (question_id, tokens) by BM25; ties go to the smaller id.

    boosted: pairs (question_id, node_id) that get `boost`, with tokens in common or without. Null or empty tokens find
    boosted nodes alone; repeated tokens count once, rows with the same question_id are one question.
    """
    postings = _read(spark, f"{path}/postings")
    kept = spark.read.parquet(f"{path}/tokens/data")
    sizes = spark.read.parquet(f"{path}/lengths/data").first()  # one row
    impact = _impact(F.col("idf"), F.col("k1"), F.col("b"), sizes["avg_n"])
    asked = questions.select("question_id", F.explode("tokens").alias("token")).distinct().join(kept, "token")
    kth = F.when(F.size("best") >= k, F.get("best", F.lit(k - 1))).otherwise(0.0)
    asked = asked.select("question_id", "token", F.get("best", F.lit(0)).alias("most"), kth.alias("kth"), "idf", "k1", "b")
    each = Window.partitionBy("question_id")  # the tokens of a question
    rising = each.orderBy("most", "token").rowsBetween(Window.unboundedPreceding, 0)
    known = asked.withColumns({"threshold": F.max("kth").over(each), "total": F.sum("most").over(each), "reach": F.sum("most").over(rising)})
    known = known.withColumns({"common": F.col("reach") < F.col("threshold") - SLACK, "need": F.col("threshold") - (F.col("total") - F.col("most")) - SLACK, "part": F.pmod(F.xxhash64("token"), F.lit(sizes["parts"])).cast("int")})
    known = staged(known, "questions-tokens")
    hits = postings.join(known.where("NOT common"), ["part", "token"]).withColumn("impact", impact).where("impact >= need")
    # the idf tells how many postings a token has; a node has few tokens of a question, so adding up before the move only takes memory
    rows = known.where("NOT common").agg(F.sum((sizes["docs"] + 1) * F.exp(-F.col("idf")))).first()[0]  # one row
    hits = hits.select("question_id", "node_id", "impact").repartition(partitions(int(rows or 0), HITS), "question_id", "node_id")
    far = known.groupBy("question_id").agg(F.sum(F.when(F.col("common"), F.col("most")).otherwise(0.0)).alias("far"), F.first("threshold").alias("threshold"))
    near = staged(hits.groupBy("question_id", "node_id").agg(F.sum("impact").alias("near")), "questions-near")
    # k nodes have at least the k-th sum known so far, so whoever cannot reach that with the common tokens is out
    kth_near = best_of(near.withColumnRenamed("near", "score"), k).groupBy("question_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("kth_near"))
    far = far.join(kth_near, "question_id").withColumn("least", F.greatest("threshold", "kth_near") - SLACK)
    some = near.join(far, "question_id").where(F.col("near") + F.col("far") >= F.col("least")).select("question_id", "node_id")
    if boosted is not None:
        some = some.unionByName(boosted.join(questions.select("question_id"), "question_id", "left_semi").select("question_id", "node_id")).distinct()
    candidates = staged(some, "questions-candidates")
    dropped(near)
    wanted = candidates.join(known.select("question_id", "token", "part", "idf", "k1", "b"), "question_id")
    terms = postings.join(wanted, ["part", "token", "node_id"]).withColumn("impact", impact).groupBy("question_id", "node_id").agg(F.sort_array(F.collect_list(F.struct("token", "impact"))).alias("terms"))
    total = F.aggregate(F.coalesce("terms.impact", F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + x)  # in the order of tokens
    if boosted is None:
        scored = terms.select("question_id", "node_id", total.alias("score"))
    else:
        pairs = boosted.select("question_id", "node_id").distinct().withColumn("extra", F.lit(float(boost)))
        scored = candidates.join(terms, ["question_id", "node_id"], "left").join(pairs, ["question_id", "node_id"], "left").select("question_id", "node_id", (total + F.coalesce("extra", F.lit(0.0))).alias("score"))
    return best_of(scored, k)


def named_articles(questions: DataFrame, nodes: DataFrame, text: str = "question", id_col: str = "id") -> DataFrame:
    """Pairs (question_id, node_id) of questions and the nodes of the articles that they name: a join on the number."""
    number = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?:điều|dieu)\s+(\d+)"))))
    asked = questions.where(F.col(text).isNotNull()).select("question_id", number.alias("article"))
    places = nodes.select(F.col(id_col).alias("node_id"), F.regexp_extract(id_col, r"_dieu-(\d+)", 1).alias("article")).where("article <> ''")
    return asked.join(places, "article").select("question_id", "node_id").distinct()


def best_of(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows (question_id, node_id, score) of each question, numbered by place; tasks keep k rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "node_id"))
    return scored.select("question_id", "node_id", "score").withColumn("place", place).where(F.col("place") <= k)


# Vectors.
#: Centroids are made of at most so many vectors, and take at most so many bytes on each executor.
SAMPLE, CENTROID_BYTES = 65_536, 32 << 20
#: Rows of one side of a block of products.
BLOCK = 8192


def _units(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(vector: str):
    """Vectors without null or non-finite components, and not zero."""
    v = F.col(vector)
    return F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _centroids(unit: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; a cell that loses all its vectors keeps its centroid."""
    points = unit[np.linspace(0, len(unit) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(part @ points.T).argmax(axis=1) for part in np.array_split(unit, max(1, len(unit) // BLOCK))])
        sums = np.zeros_like(points)
        np.add.at(sums, own, unit)
        size = np.sqrt((sums * sums).sum(axis=1))
        points[size > 0] = sums[size > 0] / size[size > 0, None]
    return points


def vector_index(vectors: DataFrame, path: str, key: str, cells: int | None = None, id_col: str = "node_id", vector: str = "embedding") -> str:
    """An inverted file of vectors (node_id, embedding) at `path`: folders by cell, and the cells with centroid, size and width.

    cells: by default the root of the number of vectors, bounded by CENTROID_BYTES. Centroids come from a bounded sample
    (SAMPLE, by a hash of the id); every vector is indexed but those that are null or zero or hold null or non-finite
    components. Vectors must have one length. An empty table gives an index that finds nothing.
    """
    spark = vectors.sparkSession

    def table() -> DataFrame:
        rows = staged(vectors.where(_usable(vector)).select(F.col(id_col).alias("node_id"), F.col(vector).cast("array<double>").alias("v")), "vector-rows")
        shape = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()  # one row
        if shape["low"] != shape["high"]:
            raise ValueError("vectors of one length are needed")
        n, length = shape["n"], shape["high"] or 1
        count = max(1, min(cells or round(n**0.5), n, SAMPLE, CENTROID_BYTES // (8 * length)))
        # the sample is thinned by the hash first, so that tasks do not send a whole sample each
        draw = F.pmod(F.xxhash64("node_id"), F.lit(1 << 30))
        some = rows.withColumn("draw", draw).where(F.col("draw") <= min(1.0, 2 * SAMPLE / max(1, n)) * (1 << 30)).orderBy("draw", "node_id").limit(SAMPLE).select("v").toPandas()["v"]
        points = _centroids(_units(some), min(count, len(some))) if len(some) else np.ones((1, length))
        sent = spark.sparkContext.broadcast(points)

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    cosine = _units(batch["v"]) @ sent.value.T
                    own = cosine.argmax(axis=1)
                    yield batch.assign(angle=np.arccos(np.clip(cosine[np.arange(len(own)), own], -1, 1)), cell=own.astype(np.int32))

        told = rows.mapInPandas(placed, "node_id " + rows.schema["node_id"].dataType.simpleString() + ", v array<double>, angle double, cell int")
        _foldered(told.repartition("cell", F.pmod(F.xxhash64("node_id"), F.lit(8))), f"{path}/vectors", "cell")
        dropped(rows)
        made = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "cell int, centroid array<double>")
        return _read(spark, f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("width")).join(made, "cell").select("cell", "centroid", "n", "width")

    cached(f"{path}/cells", key, table, spark)
    return path


def _compared(index: DataFrame, cells: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(question_id, node_id, score): the k best of each block of the cells that a question probes. pairs: (question_id, q, cell).

    A cell's vectors and its questions are dealt into slices of about BLOCK rows; a pair of slices is one product of matrices.
    """
    named = [r["cell"] for r in pairs.select("cell").distinct().collect()]  # cells are bounded; the filter prunes folders
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"question_id {kind(pairs, 'question_id')}, node_id {kind(index, 'node_id')}, score double"
    if not named:
        return index.sparkSession.createDataFrame([], schema)
    many = pairs.groupBy("cell").agg(F.count("*").alias("m")).join(cells.select("cell", "n"), "cell").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("a"), F.ceil(F.col("m") / BLOCK).cast("int").alias("b"))
    many = F.broadcast(staged(many, "vector-slices"))
    slices = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = index.where(F.col("cell").isin(named)).join(many, "cell").withColumn("i", F.pmod(F.xxhash64("node_id"), "a").cast("int")).withColumn("j", slices("b")).select("cell", "i", "j", "node_id", "v")
    right = pairs.join(many, "cell").withColumn("j", F.pmod(F.xxhash64("question_id"), "b").cast("int")).withColumn("i", slices("a")).select("cell", "i", "j", "question_id", "q")

    def scored(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            rows = rows.sort_values("node_id", ignore_index=True)  # ties go to the smaller id
            unit, ids, names = _units(rows["v"]), rows["node_id"].to_numpy(), asked["question_id"].to_numpy()
            points = _units(asked["q"])
            for at in range(0, len(points), 1024):
                cosine = points[at : at + 1024] @ unit.T
                keep = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"question_id": np.repeat(names[at : at + 1024], keep.shape[1]), "node_id": ids[keep].ravel(), "score": np.take_along_axis(cosine, keep, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"question_id": asked["question_id"][:0], "node_id": rows["node_id"][:0], "score": np.zeros(0)})

    return left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInPandas(scored, schema)


def vector_many(spark: SparkSession, path: str, questions: DataFrame, k: int = 10, probes: int = 4, exact: bool = True, vector: str = "embedding") -> DataFrame:
    """(question_id, node_id, score, place): the k nearest by cosine of each question (question_id, embedding), from a `vector_index`.

    The `probes` nearest cells are read first. `exact`: all further cells that can hold a vector above the k-th score found
    are read as well; without it the first probes are the answer. A question with a vector that cannot be compared, or
    of another length than the index has, finds nothing.
    """
    cells = spark.read.parquet(f"{path}/cells/data")
    index = _read(spark, f"{path}/vectors").select("node_id", "v", "cell")
    held = cells.orderBy("cell").toPandas()  # bounded by CENTROID_BYTES
    if not len(held):
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        return spark.createDataFrame([], f"question_id {kind(questions, 'question_id')}, node_id {kind(index, 'node_id')}, score double, place int")
    points, widths, numbers = np.stack(held["centroid"].to_list()), held["width"].to_numpy(), held["cell"].to_numpy()
    sent = spark.sparkContext.broadcast((points, widths, numbers))
    asked = questions.where(_usable(vector) & (F.size(vector) == points.shape[1])).select("question_id", F.col(vector).cast("array<double>").alias("q"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells of a question by rank of centroid, with the best cosine that a vector in it can have."""
        points, widths, numbers = sent.value
        for batch in batches:
            for part in (batch.iloc[i : i + 256] for i in range(0, len(batch), 256)):
                angle = np.arccos(np.clip(_units(part["q"]) @ points.T, -1, 1))
                rank = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1, kind="stable")
                bound = np.cos(np.maximum(0.0, angle - widths[None, :] - SLACK)) + SLACK
                yield pd.DataFrame({"question_id": part["question_id"], "q": part["q"], "cells": [[{"rank": int(r), "cell": int(c), "bound": float(x)} for r, c, x in zip(rs, numbers, xs)] for rs, xs in zip(rank, bound)]})

    ranked = staged(asked.mapInPandas(near, f"question_id {questions.schema['question_id'].dataType.simpleString()}, q array<double>, cells array<struct<rank:int,cell:int,bound:double>>"), "vector-probes")
    opened = lambda rows, keep: rows.select("question_id", "q", F.explode(F.filter("cells", keep)).alias("c")).select("question_id", "q", "c.cell")
    first = staged(best_of(_compared(index, cells, opened(ranked, lambda c: c["rank"] < probes), k), k), "vector-first")
    if not exact:
        return first
    floor = first.groupBy("question_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("floor"))
    left = ranked.join(floor, "question_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    more = staged(opened(left, lambda c: (c["rank"] >= probes) & (c["bound"] >= F.col("floor"))), "vector-more")
    return best_of(first.select("question_id", "node_id", "score").unionByName(_compared(index, cells, more, k)), k)


def merged_many(lexical: DataFrame, vector: DataFrame, k: int, slots: int = 4) -> DataFrame:
    """Anchors (question_id, node_id, score, retrieval_source, place): up to `slots` lexical rows first, then vector rows, each id once, k a question.

    Lexical scores are shares of the question's best one.
    """
    top = F.max("score").over(Window.partitionBy("question_id"))
    said = lexical.withColumn("score", F.col("score") / top).where(F.col("place") <= slots).withColumn("retrieval_source", F.lit("LEXICAL"))
    near = vector.withColumns({"place": F.col("place") + slots, "retrieval_source": F.lit("VECTOR")})
    columns = ["question_id", "node_id", "score", "retrieval_source", "place"]
    both = said.select(*columns).unionByName(near.select(*columns))
    first = both.withColumn("again", F.row_number().over(Window.partitionBy("question_id", "node_id").orderBy("place"))).where("again = 1").drop("again")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("place"))).where(F.col("place") <= k).select(*columns)


def parents_many(nodes: DataFrame, anchors: DataFrame, limit: int = 30, levels: int = 3) -> DataFrame:
    """(question_id, id, graph_distance, place): the nodes above the anchors (question_id, node_id), the nearest first."""
    from .graph import ancestors

    above = ancestors(nodes, levels).join(anchors.select("question_id", F.col("node_id").alias("id")), "id")
    found = above.groupBy("question_id", F.col("ancestor").alias("id")).agg(F.min("distance").alias("graph_distance"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("graph_distance", "id"))
    return found.withColumn("place", place).where(F.col("place") <= limit)


def below_many(nodes: DataFrame, anchors: DataFrame, levels: int = 2, limit: int = 200) -> DataFrame:
    """(question_id, id, graph_distance, place): the nodes one or two levels below the anchors, by distance, position and id."""
    from .graph import ancestors

    if not 1 <= levels <= 2:
        raise ValueError("descendants go one or two levels down")
    under = ancestors(nodes, levels).join(anchors.select("question_id", F.col("node_id").alias("ancestor")), "ancestor")
    found = under.groupBy("question_id", "id").agg(F.min("distance").alias("graph_distance")).join(nodes.select("id", "position"), "id")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("graph_distance", "position", "id"))
    return found.withColumn("place", place).where(F.col("place") <= limit).select("question_id", "id", "graph_distance", "place")
