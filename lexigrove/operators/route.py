"""Routing of nodes by pattern and vector score, and its evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns with category and strength, in order of preference.
SIGNALS = [
    (r"theo quy định tại", "CROSS_REF", 1.0),
    (r"căn cứ(?: khoản| điều| điểm)?", "CROSS_REF", 1.0),
    (r"quy định tại(?: khoản| điều| điểm)?", "CROSS_REF", 1.0),
    (r"trừ trường hợp", "EXCEPTION", 1.0),
    (r"ngoại lệ", "EXCEPTION", 1.0),
    (r"trừ khi", "EXCEPTION", 1.0),
    (r"ngoại trừ", "EXCEPTION", 1.0),
    (r"trong trường hợp", "CONDITION", 0.4),
    (r"điều kiện", "CONDITION", 0.4),
]
DEFAULT_THRESHOLD, THRESHOLD, MIN_CHARS = 0.75, 0.85, 5


def pattern_signal(text: str, signals: list[tuple] = SIGNALS) -> Column:
    """struct(score, category): the strongest pattern in the text, of equals the first."""
    by_strength = sorted(range(len(signals)), key=lambda i: (-signals[i][2], i))
    found = None
    for i in by_strength:
        pattern, category, strength = signals[i]
        hit = F.lower(F.col(text)).rlike(pattern)
        value = F.struct(F.lit(float(strength)).alias("score"), F.lit(category).alias("category"))
        found = F.when(hit, value) if found is None else found.when(hit, value)
    return found.otherwise(F.struct(F.lit(0.0).alias("score"), F.lit("NONE").alias("category")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; a zero norm counts as 1e-10."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    safe = lambda n: F.when(n == 0, F.lit(1e-10)).otherwise(n)
    return dot(a, b) / (safe(norm(a)) * safe(norm(b)))


#: Anchors are a stated set of few vectors; a larger table is not one.
MOST_ANCHORS = 10_000


def anchor_scores(vectors: DataFrame, anchors: DataFrame, id_col: str = "node_id", vector: str = "embedding") -> DataFrame:
    """(id, embed_score): the largest cosine with any anchor, 0 without anchors.

    The anchors are a stated query set; they are read once, checked in size and sent to the executors, and each batch of
    vectors is one product of matrices.
    """
    import numpy as np

    rows = anchors.select(F.col(vector).cast("array<double>").alias("v")).limit(MOST_ANCHORS + 1).collect()
    if len(rows) > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors: compare in blocks")
    points = np.array([r["v"] for r in rows], float)

    def unit(x):
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1e-10, n)

    if not len(points):
        return vectors.select(id_col, F.lit(0.0).alias("embed_score"))
    sent = vectors.sparkSession.sparkContext.broadcast(unit(points))

    @F.pandas_udf("double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series((unit(np.array(batch.tolist(), float)) @ sent.value.T).max(axis=1)) if len(batch) else pd.Series([], dtype=float)

    return vectors.select(id_col, best(F.col(vector)).alias("embed_score"))


def fuse_scores(pattern: Column, embed: Column, mode: str = "EXP-C") -> Column:
    """EXP-A: patterns alone; EXP-B: vectors alone; EXP-C: the larger; any other: patterns."""
    return embed if mode == "EXP-B" else F.greatest(pattern, embed) if mode == "EXP-C" else pattern


def route(nodes: DataFrame, scores: DataFrame | None = None, mode: str = "EXP-C", threshold: float = THRESHOLD, text: str = "text", signals: list[tuple] = SIGNALS) -> DataFrame:
    """Nodes (node_id, type, text) to (node_id, route, routing_score, reason); `scores`: (node_id, embed_score)."""
    rows = nodes.withColumn("__s", pattern_signal(text, signals))
    rows = rows.join(scores, "node_id", "left") if scores is not None else rows.withColumn("embed_score", F.lit(0.0))
    score = fuse_scores(F.col("__s.score"), F.coalesce("embed_score", F.lit(0.0)), mode)
    rows = rows.withColumn("__score", score)
    structural, empty = F.col("type").isin("CHAPTER", "SECTION"), F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) <= MIN_CHARS
    chosen, low = F.col("__score") >= threshold, F.col("__score") > 0
    kind = F.col("__s.category")
    reason = (
        F.when(structural, "STRUCTURAL_NODE").when(empty, "EMPTY_NODE")
        .when(chosen, F.when(kind != "NONE", kind).otherwise("EMBEDDING"))
        .when(low, F.when(kind != "NONE", F.concat(F.lit("LOW_CONFIDENCE_"), kind)).otherwise("LOW_CONFIDENCE"))
        .otherwise("NO_TRIGGER")
    )
    where = F.when(structural, "RULE_ONLY").when(empty, "REJECT").when(chosen, "LLM_CANDIDATE").otherwise("REJECT")
    return rows.select("node_id", where.alias("route"), F.when(structural | empty, F.lit(0.0)).otherwise(F.col("__score")).alias("routing_score"), reason.alias("reason"))


def strategies(scored: DataFrame) -> DataFrame:
    """Rows (.., pattern_score, embed_score) to one row for each way to fuse them: (strategy, score)."""
    p, e = F.col("pattern_score"), F.col("embed_score")
    ways = {"embed_only": e, "average": (p + e) / 2, "weighted_0.7": 0.7 * p + 0.3 * e, "weighted_0.3": 0.3 * p + 0.7 * e, "max": F.greatest(p, e)}
    return scored.withColumn("__w", F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), v.alias("score")) for k, v in ways.items()]))).withColumns({"strategy": F.col("__w.strategy"), "score": F.col("__w.score")}).drop("__w")


def sweep(scored: DataFrame, low: int = 30, high: int = 100, step: int = 5, by: tuple = ()) -> DataFrame:
    """Rows (score, label) to counts, precision, recall and F1 at each threshold from low to high percent.

    Rows are first counted by score cell, so a threshold costs a row for each cell and not for each node.
    """
    cells = scored.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    at = cells.withColumn("pct", F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step)))).withColumn("threshold", F.col("pct") / 100.0)
    hit = F.col("score") >= F.col("threshold")
    n = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    counts = at.groupBy(*by, "threshold").agg(n("pos", hit).alias("tp"), n("neg", hit).alias("fp"), n("neg", ~hit).alias("tn"), n("pos", ~hit).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    counts = counts.withColumns({"cost": F.col("tp") + F.col("fp"), "precision": p, "recall": r})
    return counts.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def operating_point(swept: DataFrame, target: float = 0.9, by: tuple = ()) -> DataFrame:
    """The cheapest threshold with enough recall; ties go to more recall, then precision, then the lower threshold."""
    order = Window.partitionBy(*by).orderBy("cost", F.desc("recall"), F.desc("precision"), "threshold")
    return swept.where(F.col("recall") >= target).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def evaluate(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, label) and (id, predicted) to precision, recall and F1; no prediction counts as 0."""
    both = truth.join(predictions, "id", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    c = lambda a, b: F.count_if((F.col("label") == a) & (F.col("predicted") == b))
    n = both.agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return n.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def weak_label(text: str, words: list[str]) -> Column:
    """1 if any of the words is in the text."""
    return F.lower(F.coalesce(F.col(text), F.lit(""))).rlike("|".join(words)).cast("int")


def seeded_sample(rows: DataFrame, n: int = 50, seed: int = 42, id_col: str = "id") -> DataFrame:
    """The n rows of smallest hash: the same for each run and partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(n)


def content_hash(rows: DataFrame, text: str, order: str, parts: int = 256) -> str:
    """A hash of all texts in order: hashes of ranges, then a hash of these, so that no task holds all texts."""
    cut = rows.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h"), F.col(order).alias("o"))
    bits = cut.groupBy(F.pmod(F.xxhash64("o"), F.lit(parts)).alias("part")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: F.concat_ws(":", x["o"].cast("string"), x["h"])), "|"), 256).alias("h"))
    return bits.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), 256).alias("h")).first()["h"]


def cached(path: str, key: str, make: Callable[[], DataFrame], spark) -> DataFrame:
    """The table at `path` if it was made for `key`, else a new one; the key stands in a table beside it."""
    from pyspark.errors import AnalysisException

    try:
        if spark.read.parquet(f"{path}/key").first()["key"] == key:
            return spark.read.parquet(f"{path}/data")
    except AnalysisException:
        pass
    make().write.mode("overwrite").parquet(f"{path}/data")
    spark.createDataFrame([(key,)], "key string").write.mode("overwrite").parquet(f"{path}/key")
    return spark.read.parquet(f"{path}/data")


def full_evaluation(nodes: DataFrame, *experiments: tuple[str, DataFrame]) -> DataFrame:
    """Nodes with route and score of each experiment (name, routes) beside them."""
    out = nodes
    for name, routes in experiments:
        out = out.join(routes.select("node_id", F.col("route").alias(f"{name}_route"), F.col("routing_score").alias(f"{name}_score")), "node_id", "left")
    return out
