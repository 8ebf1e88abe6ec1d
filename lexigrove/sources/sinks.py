"""Sinks: tables, graphs with dead letters, upserts, deltas, logs, calibrators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, fuse
from ..operators.graph import edge_key
from . import loaders


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; the commit protocol makes the output whole or absent."""
    df.write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, metadata: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    metadata.write.mode("overwrite").json(f"{path}/metadata")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_report(summary: DataFrame, issues: DataFrame, path: str) -> None:
    write_json(summary, f"{path}/summary")
    write_json(issues, f"{path}/issues")


def write_routes(routes: DataFrame, path: str) -> dict[str, int]:
    """Routes, with how many there are and how many are candidates; counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation("routes")
    watched = routes.observe(seen, F.count(F.lit(1)).alias("total_evaluated"), F.count_if(F.col("route") == "LLM_CANDIDATE").alias("total_candidates"))
    watched.write.mode("overwrite").parquet(path)
    return dict(seen.get)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The old rows, replaced where a new row has their key; new values win, nulls in them keep the old ones."""
    own = [c for c in old.columns if c != key]
    fresh = new.select(key, *[F.col(c).alias(f"__{c}") for c in own if c in new.columns])
    both = old.join(fresh, key, "full_outer")
    return both.select(key, *[F.coalesce(f"__{c}", c).alias(c) if c in new.columns else F.col(c) for c in own])


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by their key; only new ones between two nodes are taken, once each, and their properties replace the old ones.

    Columns that only one side has are null on the other; a null new value keeps the old one.
    """
    ids = nodes.select("id").distinct()
    good = new.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    key, own = ["source", "target", "type"], [c for c in dict.fromkeys((*old.columns, *new.columns)) if c not in ("source", "target", "type", "edge_key")]
    rows = old.withColumn("__new", F.lit(0)).unionByName(good.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    # of several rows on a side the one with the largest values: a choice that does not depend on their order
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("__new", F.col(c).alias("v"))))["v"].alias(c)
    merged = rows.groupBy(*key).agg(*[last(c) for c in own]) if own else rows.select(*key).distinct()
    return merged.withColumn("edge_key", edge_key())


def ingest(nodes: DataFrame, edges: DataFrame, law_code: str | None = None, labels: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges to load, dead letters with a reason, one row of counters). Ends are looked up once for each side."""
    ids = nodes.select("id").distinct()
    if labels is not None:
        odd = nodes.where(F.size(F.array_except("labels", F.array(*map(F.lit, labels)))) > 0)
        if not odd.isEmpty():
            raise ValueError("a label is not allowed")
    e = edges.join(ids.select(F.col("id").alias("source"), F.lit(1).alias("__s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(1).alias("__t")), "target", "left")
    reason = F.when(F.col("__s").isNull() & F.col("__t").isNull(), "missing_both").when(F.col("__s").isNull(), "missing_source").when(F.col("__t").isNull(), "missing_target")
    e = e.withColumn("reason", reason).drop("__s", "__t")
    if law_code is not None:
        e = e.withColumn("law_code", F.coalesce("law_code", F.lit(law_code)) if "law_code" in e.columns else F.lit(law_code))
    counters = e.agg(F.count_if(F.col("reason").isNull()).alias("loaded"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("missing_source", "missing_target", "missing_both")])
    return e.where("reason is null").drop("reason"), e.where("reason is not null"), counters


def require_schema(nodes: DataFrame, dimension: int | None = None) -> None:
    """What a database would hold by its indexes: unique ids, and one length of vectors."""
    if not nodes.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("ids are not unique")
    if dimension is not None:
        if dimension <= 0:
            raise ValueError("the dimension is a positive number")
        if not nodes.where(F.col("embedding").isNotNull() & (F.size("embedding") != dimension)).isEmpty():
            raise ValueError("a vector has another length")


def replace_law(df: DataFrame, path: str) -> None:
    """Rows by law_code; only the laws that `df` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("law_code").parquet(path)


def apply_delta(nodes: DataFrame, edges: DataFrame, delta: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after a delta with all six parts; an edge that would lack an end is an error."""
    d = fuse.checked_delta(delta)
    new_nodes = fuse.apply_delta(nodes, d["added_nodes"].unionByName(d["updated_nodes"]), d["removed_nodes"])
    key = ("source", "target", "type")
    new_edges = fuse.apply_delta(edges, d["added_edges"].unionByName(d["updated_edges"]), d["removed_edges"], key)
    new_edges = new_edges.join(d["removed_nodes"].select(F.col("id").alias("source")), "source", "left_anti").join(d["removed_nodes"].select(F.col("id").alias("target")), "target", "left_anti").select(*edges.columns)
    changed = d["added_edges"].unionByName(d["updated_edges"])
    ids = new_nodes.select("id")
    lost = changed.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").unionByName(changed.join(ids.withColumnRenamed("id", "target"), "target", "left_anti"))
    if not lost.isEmpty():
        raise ValueError("a changed edge has no node at an end")
    return new_nodes, new_edges


def append_answers(answers: DataFrame, path: str) -> None:
    answers.write.mode("append").json(path)


def save_calibrator(fit: DataFrame, path: str) -> None:
    if fit.isEmpty():
        raise ValueError("the calibrator is not fitted")
    fit.select(F.lit("isotonic_pav_v1").alias("method"), "threshold", "value", "n").coalesce(1).write.mode("overwrite").json(path)


def load_calibrator(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("method string, threshold double, value double, n long").json(path)
    if df.isEmpty() or not df.where("method is distinct from 'isotonic_pav_v1' or threshold is null or value is null").isEmpty():
        raise ValueError("no calibrator of this format")
    return df.drop("method")


def clean_files(spark: SparkSession, path: str, out: str) -> DataFrame:
    """All files of a glob cleaned in one job, a text each; (doc, status, n_lines, n_chars). A file that is broken fails alone."""
    if path.lower().endswith("docx"):
        raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), "content").mapInPandas(loaders._paragraphs, "doc string, index int, text string, word_style string, num_id int, ilvl int, num_fmt string, lvl_text string, start int, broken boolean")
        failed = raw.where("broken").select("doc", F.lit("failed").alias("status"))
        lines = loaders.plain_lines(loaders.split_points(loaders.numbered(raw.where("not broken"))))
    else:
        failed = spark.createDataFrame([], "doc string, status string")
        lines = loaders.plain_lines(loaders.text(spark, path))
    texts = clean.formatted(clean.normalized(clean.cleaned(lines)).drop("changed"))
    texts.write.mode("overwrite").parquet(out)
    done = spark.read.parquet(out)
    counts = done.select("doc", F.lit("ok").alias("status"), (F.size(F.split("text", "\n")) - 1).alias("n_lines"), F.length("text").alias("n_chars"))
    return counts.unionByName(failed, allowMissingColumns=True)
