"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of the mix, with a ceiling on repetition. A document is expected `target / source_size`
times (times its own weight, if one is given): the whole part are certain copies, the rest is an inclusion probability
p. Documents are ranked by random odds over inclusion odds, u/(1-u) / (p/(1-p)), and the first are taken until the
sample has the words that the certain copies leave open, so its size is fixed and inclusion follows p.

The rank prefix is found without sorting a source in one task: ranks are counted into fine cells per source (summed on
the map side), running sums over the cells give the cell in which the quota is met, and only that cell is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, staged

CELLS = 1 << 16


def targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Weights go to the sources by code point, null last, repeating. Targets share `share` times all words by weight, but
    stop at `ceiling` times the source's size; the excess is shared among the others by weight until none is above. That
    is the level t at which sum(min(ceiling * size, t * weight)) is the whole: sources are ordered by ceiling per weight and
    the first ones are full. One row per source is sorted, never documents.
    """
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = ranked.withColumns({"cap": F.col("source_size") * ceiling, "total": F.sum("source_size").over(whole) * F.lit(share), "w_all": F.sum("w").over(whole)}).withColumns(
        {"full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_full": F.coalesce(F.sum("w").over(before), F.lit(0.0))}
    )
    # the level if all before this source are full and it and the later ones are not; the first that holds is the answer
    level = level.withColumn("t", (F.col("total") - F.col("full")) / (F.col("w_all") - F.col("w_full")))
    level = level.withColumn("t", F.min(F.when(F.col("t") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "t"))).over(whole)["t"])
    return level.select("source", "source_size", F.when(F.col("t").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("t") * F.col("w"))).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    keep: tuple = (),
) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, copies, source), one for each row of `docs`.

    size: words of the text (null: 0). taken = copies * size; copies is the whole part of the expectation, or one more.
    The draw depends on seed, doc_id and size alone, so reruns agree; rows equal in these are ranked in any order, which
    leaves the multiset of results the same. Documents without words are expected like any other of their source, add
    nothing to its quota, and never get an extra copy. An empty table gives an empty result; null sources are one source.
    Other columns are left out, but for those in `keep`, which follow. `weight_col`: own weights (positive) for unequal probabilities within a source; null counts as 1.
    """
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)) if weight_col else F.lit(1.0)
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), weight.alias("weight"), *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]), "mix-sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("weighed"))
    goal = staged(targets(by_source.select("source", "source_size"), weights, share, ceiling).join(by_source.select(F.col("source").alias("s"), "weighed"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 11).cast("double") + 0.5) / float(1 << 53)
    most = F.lit(float(int(ceiling)))
    expected = F.when(F.col("weighed") > 0, F.least(F.col("target") / F.col("weighed") * F.col("weight"), most)).otherwise(F.lit(0.0))
    drawn = (
        rows.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumns({"u": u, "e": expected})
        .withColumns({"certain": F.floor("e"), "p": F.col("e") - F.floor("e")})
        .withColumn("odds", F.when((F.col("p") > 0) & (F.col("size") > 0), F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))))
        .withColumn("cell", F.when(F.col("odds").isNotNull(), F.floor(F.col("odds") / (1 + F.col("odds")) * CELLS).cast("int")))
    )
    cells = drawn.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.sum(F.col("certain") * F.col("size")).alias("certain_words"), F.max("target").alias("target"))
    at = Window.partitionBy("source")
    found = (
        cells.withColumns({"quota": F.max("target").over(at) - F.sum("certain_words").over(at), "through": F.sum(F.when(F.col("cell").isNotNull(), F.col("words"))).over(at.orderBy(F.col("cell").asc_nulls_first()))})
        .where("cell is not null and through - words < quota")
        .groupBy("source")
        .agg(F.max(F.struct("cell", (F.col("quota") - F.col("through") + F.col("words")).alias("open"))).alias("last"))
        .select(F.col("source").alias("s"), F.col("last.cell").alias("last_cell"), F.col("last.open").alias("open"))
    )
    found = staged(found, "mix-cells")
    ranked = drawn.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    edge = F.col("cell") == F.col("last_cell")
    run = Window.partitionBy("source").orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    sure = ranked.where(~F.coalesce(edge, F.lit(False))).withColumn("extra", F.coalesce((F.col("cell") < F.col("last_cell")).cast("long"), F.lit(0)))
    # in the last cell a document is taken if that brings the sum nearer to the quota
    close = ranked.where(edge).withColumn("extra", (F.sum("size").over(run) - F.col("size") / 2 <= F.col("open")).cast("long"))
    return sure.unionByName(close).select(
        "doc_id", "size", "source_size", "target", ((F.col("certain") + F.col("extra")) * F.col("size")).cast("long").alias("taken"), (F.col("certain") + F.col("extra")).cast("long").alias("copies"), "source", *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """`docs` with each row as often as the mix takes it: no row, one or two. All columns are kept."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source")
    taken = mix(rows, keep=("row",), **options).where("copies > 0")
    return taken.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
