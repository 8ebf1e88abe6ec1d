"""Calibration, agreement and classification statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import dropped, staged

CELLS = 10_000


def _pooled(frame):
    """Adjacent violators of blocks (threshold, pos, n) in the order of their thresholds are pooled."""
    import pandas as pd

    blocks: list[list[float]] = []
    for s, p, n in frame.sort_values("threshold")[["threshold", "pos", "n"]].itertuples(index=False):
        top, pos, count = s, p, n
        while blocks and blocks[-1][1] / blocks[-1][2] > pos / count:
            _, p0, n0 = blocks.pop()
            pos, count = pos + p0, count + n0
        blocks.append([top, pos, count])
    return pd.DataFrame({"threshold": [b[0] for b in blocks], "pos": [b[1] for b in blocks], "n": [b[2] for b in blocks]})


def _joined(blocks: DataFrame) -> DataFrame:
    """Neighbouring ranges (part 2i and 2i+1) become one: blocks (part, threshold, pos, n) that rise within each part.

    Only blocks of the left range above the lowest of the right one, and of the right range below the highest of the left
    one, can be pooled with each other; they alone go to a task, all others stay as they are.
    """
    value, pair, left = F.col("pos") / F.col("n"), F.floor(F.col("part") / 2), F.col("part") % 2 == 0
    ends = blocks.groupBy(pair.alias("pair")).agg(F.max(F.when(left, value)).alias("high"), F.min(F.when(~left, value)).alias("low"))
    told = blocks.withColumn("pair", pair).join(ends, "pair").withColumn("meets", F.coalesce(F.when(left, value > F.col("low")).otherwise(value < F.col("high")), F.lit(False)))

    def pooled(key, frame):
        return _pooled(frame).assign(part=key[0])[["part", "threshold", "pos", "n"]]

    moved = told.where("meets").groupBy("pair").applyInPandas(pooled, "part long, threshold double, pos double, n double")
    return told.where("NOT meets").select(F.col("pair").alias("part"), "threshold", "pos", "n").unionByName(moved)


#: Distinct scores of a range, and the least number of ranges.
RANGE_ROWS, LEAST_RANGES = 50_000, 4


def isotonic_fit(rows: DataFrame, score: str = "score", label: str = "label", ranges: int | None = None) -> DataFrame:
    """Pooled blocks (threshold, value, n) of an isotonic regression of 0/1 labels on scores.

    Counts by distinct score are made by an aggregation and dealt into `ranges` of scores of about equal numbers. Violators
    are pooled within each range, then neighbouring ranges are joined in a tree of as many rounds as the logarithm of their
    number; a task gets one range, or the blocks of two ranges that contradict each other, never all blocks. Pooling in
    parts and pooling the parts gives the same blocks. Rows without score or label are left out.
    """
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    pairs = staged(known.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count("*").cast("double").alias("n")), "isotonic-scores")
    parts = ranges or max(LEAST_RANGES, -(-pairs.count() // RANGE_ROWS))

    def pooled(key, frame):
        return _pooled(frame).assign(part=key[0])[["part", "threshold", "pos", "n"]]

    # numbers of partitions are written down before they are used, so that a task that runs again cannot change them
    dealt = staged(pairs.repartitionByRange(parts, "threshold").withColumn("part", F.spark_partition_id().cast("long")), "isotonic-ranges")
    blocks = staged(dealt.groupBy("part").applyInPandas(pooled, "part long, threshold double, pos double, n double"), "isotonic-blocks")
    dropped(pairs, dealt)
    while parts > 1:
        before, blocks, parts = blocks, staged(_joined(blocks), "isotonic-blocks"), -(-parts // 2)
        dropped(before)
    return blocks.select("threshold", (F.col("pos") / F.col("n")).alias("value"), F.col("n").cast("long").alias("n"))


def isotonic_fit_sql(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The same fit at each score, by the max-min identity: max over starts of min over ends of the mean between.

    For few distinct scores; the self-join is on them.
    """
    pairs = rows.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count("*").cast("double").alias("n"))
    order = Window.orderBy("score")
    run = pairs.select("score", F.row_number().over(order).alias("i"), F.sum("pos").over(order).alias("cp"), F.sum("n").over(order).alias("cn"), "pos", "n")
    a = run.select(F.col("i").alias("j"), (F.col("cp") - F.col("pos")).alias("p0"), (F.col("cn") - F.col("n")).alias("n0"))
    b = run.select(F.col("i").alias("k"), F.col("cp").alias("p1"), F.col("cn").alias("n1"))
    means = a.join(b, F.col("k") >= F.col("j")).select("j", "k", ((F.col("p1") - F.col("p0")) / (F.col("n1") - F.col("n0"))).alias("m"))
    low = means.withColumn("low", F.min("m").over(Window.partitionBy("j").orderBy(F.desc("k"))))
    best = low.groupBy(F.col("k").alias("i"), "j").agg(F.min("low").alias("low")).groupBy("i").agg(F.max("low").alias("value"))
    return run.join(best, "i").select("score", "value")


def isotonic_predict(rows: DataFrame, fit: DataFrame, score: str = "score") -> DataFrame:
    """With `calibrated`: the value of the first threshold that is not below the score, else the last value.

    The blocks of a fit are few: they are read once and looked up as a literal array.
    """
    steps = sorted((r["threshold"], r["value"]) for r in fit.select("threshold", "value").limit(CELLS + 1).collect())
    if not steps:
        raise ValueError("the calibrator is not fitted")
    if len(steps) > CELLS:
        raise ValueError("too many blocks: round the scores before fitting")
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(v).alias("v")) for t, v in steps])
    found = F.get(F.filter(table, lambda x: x["t"] >= F.col(score)), F.lit(0))["v"]
    return rows.withColumn("calibrated", F.coalesce(found, F.lit(steps[-1][1])))


def bin_of(score: Column, bins: int = 10) -> Column:
    """The bin [i/bins, (i+1)/bins) of a clamped score, the last one closed; edges are compared, not computed."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda e: e <= score))


def confidence_bins(rows: DataFrame, bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double")))
    return rows.select(s.alias("s"), F.col(label).cast("int").alias("y")).groupBy(bin_of(F.col("s"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("accuracy"), F.avg("s").alias("mean_confidence"))


def confidence(rows: DataFrame, bins: int = 10, threshold: float = 0.8, score: str = "score", label: str = "label") -> DataFrame:
    """One row: count, Brier score, expected calibration error, precision and recall at the threshold, to 8 places."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double")))
    cells = rows.select(s.alias("s"), F.col(label).cast("int").alias("y")).groupBy(bin_of(F.col("s"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("y").alias("ys"), F.sum("s").alias("ss"), F.sum((F.col("s") - F.col("y")) * (F.col("s") - F.col("y"))).alias("sq"),
        F.count_if((F.col("y") == 1) & (F.col("s") >= threshold)).alias("tp"), F.count_if((F.col("y") == 0) & (F.col("s") >= threshold)).alias("fp"), F.count_if((F.col("y") == 1) & (F.col("s") < threshold)).alias("fn"),
    )
    total = cells.agg(F.sum("n").alias("n"), F.sum("sq").alias("sq"), F.sum(F.abs(F.col("ys") - F.col("ss"))).alias("gap"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return total.select(F.col("n").alias("count"), F.round(F.col("sq") / F.col("n"), 8).alias("brier_score"), F.round(F.col("gap") / F.col("n"), 8).alias("expected_calibration_error"), F.lit(threshold).alias("decision_threshold"), F.round(ratio("tp", "fp"), 8).alias("precision_at_threshold"), F.round(ratio("tp", "fn"), 8).alias("recall_at_threshold"))


def classification(rows: DataFrame, positive: str | None = None) -> DataFrame:
    """(expected, predicted) to binary counts and ratios for `positive`, or to exact matches of many classes."""
    if positive is None:
        return rows.agg(F.count("*").alias("count"), F.count_if(F.col("expected").eqNullSafe(F.col("predicted"))).alias("matches")).select("count", "matches", (F.col("matches") / F.col("count")).alias("accuracy"), (F.col("count") - F.col("matches")).alias("mismatches"))
    is_, said = F.col("expected") == positive, F.coalesce(F.col("predicted") == positive, F.lit(False))
    n = rows.agg(F.count("*").alias("count"), F.count_if(is_ & said).alias("tp"), F.count_if(~is_ & said).alias("fp"), F.count_if(is_ & ~said).alias("fn"), F.count_if(~is_ & ~said).alias("tn"))
    p, r = (F.when(F.col("tp") + F.col(x) > 0, F.col("tp") / (F.col("tp") + F.col(x))).otherwise(0.0) for x in ("fp", "fn"))
    n = n.withColumns({"precision": p, "recall": r})
    return n.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def adjudicated(rows: DataFrame) -> DataFrame:
    """Rows (case_id, expected, predicted, annotation) to one row a case; the expected value, or one that all annotators share.

    A case without either, or with two expected values, is an error while it is read.
    """
    c = rows.groupBy("case_id").agg(F.count_distinct("expected").alias("n_expected"), F.max("expected").alias("given"), F.count_distinct("annotation").alias("n_notes"), F.max("annotation").alias("note"), F.max("predicted").alias("predicted"))
    bad = (F.col("n_expected") > 1) | ((F.col("n_expected") == 0) & (F.col("n_notes") != 1))
    value = F.when(bad, F.raise_error(F.concat(F.lit("no agreed value for case "), F.col("case_id").cast("string")))).otherwise(F.coalesce("given", "note"))
    return c.select("case_id", value.alias("expected"), "predicted")


def pairwise_kappa(rows: DataFrame) -> DataFrame:
    """(case_id, reviewer, label) to (first, second, n, kappa) for reviewers with shared cases.

    The join is on the case; a case has as many rows as reviewers. Chance agreement of 1 gives 1 or 0.
    """
    one, two = rows.select("case_id", F.col("reviewer").alias("first"), F.col("label").alias("a")), rows.select("case_id", F.col("reviewer").alias("second"), F.col("label").alias("b"))
    pairs = one.join(two, "case_id").where("first < second").groupBy("first", "second", "a", "b").count()
    both = Window.partitionBy("first", "second")
    cells = pairs.withColumns({"n": F.sum("count").over(both), "na": F.sum("count").over(Window.partitionBy("first", "second", "a"))})
    same = cells.groupBy("first", "second").agg(F.max("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("count")).otherwise(0)).alias("same"))
    left = pairs.groupBy("first", "second", F.col("a").alias("v")).agg(F.sum("count").alias("x"))
    right = pairs.groupBy("first", "second", F.col("b").alias("v")).agg(F.sum("count").alias("y"))
    chance = left.join(right, ["first", "second", "v"]).groupBy("first", "second").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    k = same.join(chance, ["first", "second"], "left").withColumns({"observed": F.col("same") / F.col("n"), "expected": F.coalesce("xy", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))})
    return k.select("first", "second", "n", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).otherwise((F.col("observed") == 1).cast("double")).alias("kappa"))


def mean_kappa(rows: DataFrame) -> DataFrame:
    return pairwise_kappa(rows).agg(F.avg("kappa").alias("kappa"))


# Recovery of clauses whose numbers were lost.
def clause_candidates(paragraphs: DataFrame, articles: DataFrame, hypothesis: str) -> DataFrame:
    """Paragraphs (doc, idx, text) in the ranges of articles (doc, article_id, start_idx, end_idx) as clauses, with a confidence.

    H1: the first after the heading; H2: all, less sure the later; H3: the last line that is not blank before a point.
    """
    inside = paragraphs.join(articles, "doc").where((F.col("idx") > F.col("start_idx")) & (F.col("idx") < F.col("end_idx")))
    full = inside.where(F.trim("text") != "")
    order = Window.partitionBy("doc", "article_id").orderBy("idx")
    if hypothesis in ("H1", "H2"):
        placed = full.withColumn("pos", F.row_number().over(order))
        if hypothesis == "H1":
            return placed.where("pos = 1").select("doc", "article_id", "idx", "text", F.lit(0.65).alias("confidence"))
        return placed.select("doc", "article_id", "idx", "text", F.greatest(F.lit(0.30), F.lit(0.60) - 0.05 * (F.col("pos") - 1)).alias("confidence"))
    point = F.col("text").rlike(r"^\s*[a-zđ]\)\s")
    before = F.lag(F.struct("idx", "text")).over(order)
    found = full.withColumn("__before", before).where(point & F.col("__before").isNotNull() & ~F.col("__before.text").rlike(r"^\s*[a-zđ]\)\s"))
    return found.select("doc", "article_id", F.col("__before.idx").alias("idx"), F.col("__before.text").alias("text"), F.lit(0.45).alias("confidence")).distinct()


def recovery_quality(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """Precision, recall and F1 of candidates (text) against reference clauses (text): texts match one to one, copies in order."""
    n = lambda df, name: df.groupBy(F.trim("text").alias("t")).agg(F.count("*").alias(name))
    both = n(candidates, "a").join(n(reference, "b"), "t", "full_outer").fillna(0, ["a", "b"])
    total = both.agg(F.sum(F.least("a", "b")).alias("tp"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    p, r = (F.when(F.col(x) > 0, F.col("tp") / F.col(x)).otherwise(0.0) for x in ("a", "b"))
    out = total.select("tp", p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
