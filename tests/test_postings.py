import random

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import postings, retrieve

NODES = "id string, title string, text string"


def rows(df):
    return [(r.node_id, round(r.lexical_score, 9)) for r in df.collect()]


def test_changes_give_what_a_new_index_gives(spark, tmp_path):
    """Rounds at random: added, replaced, emptied, removed and unknown nodes; after each the scores of an index made anew."""
    rng, state = random.Random(3), {}
    text = lambda: " ".join(rng.choices(["dat", "nha", "thue", "mua", "ban", "giao"], k=rng.randint(0, 7)))
    path = str(tmp_path / "live")
    for turn in range(3):
        put = {f"n{rng.randint(0, 40)}": text() for _ in range(15)}
        gone = [f"n{rng.randint(0, 45)}" for _ in range(4)]
        state = {k: v for k, v in state.items() if turn == 0 or k not in gone} | put
        nodes = spark.createDataFrame([(k, None, v) for k, v in put.items()], NODES)
        if turn == 0:
            assert postings.create(nodes, path, parts=4) == 0
        else:
            assert postings.change(spark, path, nodes, spark.createDataFrame([(g,) for g in gone], "id string")) == turn
        new = str(tmp_path / f"new{turn}")
        retrieve.lexical_index(spark.createDataFrame([(k, None, v) for k, v in state.items()], NODES), new, "k", parts=4)
        for q in (["dat", "thue"], ["none"], []):
            assert rows(postings.top(spark, path, q, k=5)) == rows(retrieve.bm25_indexed(spark, new, q, k=5)), (turn, q)
    into = str(tmp_path / "whole")
    postings.compacted(spark, path, into)
    assert rows(postings.top(spark, into, ["dat", "mua"], k=50)) == rows(postings.top(spark, path, ["dat", "mua"], k=50))
    with pytest.raises(ValueError):
        postings.create(nodes, path)


def test_a_dead_writer_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "live")
    old = spark.createDataFrame([("a", "t", "dat nha"), ("b", None, "dat")], NODES)
    with pytest.raises(ValueError):
        postings.change(spark, path, old)
    postings.create(old, path, parts=2)
    was = rows(postings.top(spark, path, ["dat"]))
    postings._write(spark.createDataFrame([("a", "t", "dat dat dat"), ("c", "t", "dat")], NODES), path, 1, 2)  # dies before its totals
    assert rows(postings.top(spark, path, ["dat"])) == was
    postings.change(spark, path, old.limit(0), spark.createDataFrame([("b",)], "id string"))
    assert [i for i, _ in rows(postings.top(spark, path, ["dat"]))] == ["a"]


def test_a_change_writes_its_own_postings(spark, tmp_path):
    path = str(tmp_path / "live")
    postings.create(spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("dat nha thue").alias("text")), path, parts=4)
    postings.change(spark, path, spark.createDataFrame([("7", "t", "mua")], NODES))
    assert spark.read.parquet(f"{path}/postings/gen=1").count() == 1  # of "mua"; one letter is no token
