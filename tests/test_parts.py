"""Partitions follow the rows: four times the rows take four times the tasks, not larger ones."""

from pyspark.sql import functions as F

from lexigrove.operators import fuse, graph


def parts(df):
    return len({r.p for r in df.select(F.spark_partition_id().alias("p")).collect()})


def test_contexts(spark, monkeypatch):
    monkeypatch.setattr(graph, "CONTEXTS", 500, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (1000, 4000):
            k = F.col("id")
            nodes = spark.range(n).select(k.cast("string").alias("id"), F.when(k >= 10, F.floor(k / 10)).cast("string").alias("parent_id"), F.when(k < 100, "ARTICLE").otherwise("CLAUSE").alias("type"), F.lit("t").alias("title"), k.cast("string").alias("text"))
            found = graph.context_path(nodes)
            assert parts(found) == n // 500
            rows = {r.id: r.context for r in found.collect()}
            # ancestors up to the first article, none above it
            assert len(rows) == n and rows["5"] == "" and rows["42"] == "- ARTICLE: t - 4" and rows["999"] == "- ARTICLE: t - 99"
            assert n < 2000 or rows["3141"] == "- ARTICLE: t - 31\n- CLAUSE: t - 314"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_snapshots(spark, monkeypatch):
    monkeypatch.setattr(fuse, "ROWS", 500, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (1000, 4000):
            old = spark.range(n).withColumn("v", F.lit(1))
            new = spark.range(10, n + 10).withColumn("v", F.when(F.col("id") % 7 == 0, 2).otherwise(1))
            d = fuse.diff(old, new)
            assert d.select("change").distinct().count() == 3
            up = new.join(d.where("change <> 'REMOVED'").select("id"), "id", "left_semi")
            kept = fuse.apply_delta(old, up.limit(0), d.where("change = 'REMOVED'"))
            assert parts(kept) >= n // 500
            whole = fuse.apply_delta(old, up, d.where("change = 'REMOVED'"))
            assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, new.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_statute(spark, sf, monkeypatch):
    """A statute is dealt by its places, not by the bytes of its file."""
    from lexigrove.plans import graph_queries

    monkeypatch.setattr(graph_queries, "PLACES", 50, raising=False)
    whole = graph_queries.law(spark, sf)
    assert whole.count() == whole.select("id").distinct().count() == 200
    assert len(whole.inputFiles()) == 4


def test_references_of_some(spark, monkeypatch):
    """References of some places are those among the references of all."""
    from lexigrove.operators import retrieve

    k = F.col("k")
    nodes = spark.range(1, 60).select(F.col("id").alias("k")).select(F.concat(F.lit("law_dieu-"), k.cast("string")).alias("id"), F.concat(F.lit("theo Điều "), (k % 9 + 1).cast("string"), F.lit(" và Điều 70")).alias("text"), F.lit("t").alias("title"), k.alias("start_idx"))
    every = sorted(map(tuple, retrieve.reference_edges(nodes, articles=(5, 12)).collect()))
    some = sorted(map(tuple, retrieve.reference_edges(nodes, articles=(5, 12), sources=nodes.where("start_idx < 20")).select(*retrieve.reference_edges(nodes, articles=(5, 12)).columns).collect()))
    first = retrieve.reference_edges(nodes, articles=(5, 12)).columns.index("source_id")
    assert some and some == [r for r in every if int(r[first].rpartition("-")[2]) < 20]


def test_hits(spark, tmp_path, monkeypatch):
    """Postings of questions are added up in partitions by their number; scores are those of one partition."""
    from lexigrove.operators import batch

    nodes = spark.range(400).select("id", F.lit("").alias("title"), F.concat(F.lit("stone word"), (F.col("id") % 7).cast("string"), F.lit(" river"), (F.col("id") % 3).cast("string")).alias("text"))
    path = batch.impact_index(nodes, str(tmp_path / "index"), "k")
    questions = spark.createDataFrame([(i, ["stone", f"word{i}", "river1"]) for i in range(5)], "question_id long, tokens array<string>")
    frame, seen = type(nodes), []
    dealt = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, n, *by: (seen.append(n) if by == ("question_id", "node_id") else None, dealt(df, n, *by))[1])
    found = []
    for n in (1 << 30, 100):
        monkeypatch.setattr(batch, "HITS", n, raising=False)
        found.append(sorted(map(tuple, batch.bm25_many(spark, path, questions, 5).collect())))
    assert found[0] == found[1] and len(found[0]) == 25 and seen[0] == 1 and seen[1] > 1
