"""A lexical index that takes changes: generations of postings, merged when they are read.

`path` holds three tables, each in folders by generation: postings (token, node_id, tf, n; by a hash of the token below),
touched (node_id, n: each node that a generation sets, 0 for one that has no token or is removed) and totals (documents
and tokens in all after it, one row). A change writes the postings of its own nodes alone. A posting counts if no later
generation touches its node, which the reader checks for the tokens of its question only. Totals are written last: a
generation without them is not there for readers, and the next change replaces what a dead writer left. One writer at a
time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import staged
from .retrieve import K1, B

TOTALS = "gen int, docs long, tokens long, parts int"


def _totals(spark: SparkSession, path: str) -> list:
    """The totals of all finished generations, newest last; one row a generation."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/totals")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return []
    return spark.read.schema(TOTALS).parquet(f"{path}/totals").orderBy("gen").collect()


def _write(nodes: DataFrame, path: str, gen: int, parts: int, removed: DataFrame | None = None) -> None:
    """Postings and touched nodes of a generation."""
    docs = nodes.select(F.col("id").alias("node_id"), T.lexical_tokens(F.concat_ws(" ", "title", "text")).alias("tokens"))
    docs = staged(docs, "posting-tokens")
    each = docs.select("node_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).groupBy("token", "node_id").agg(F.count("*").alias("tf"), F.max("n").alias("n"))
    each.withColumn("part", F.pmod(F.xxhash64("token"), F.lit(parts)).cast("int")).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings/gen={gen}")
    touched = docs.select("node_id", F.size("tokens").alias("n"))
    if removed is not None:
        touched = touched.unionByName(removed.select(F.col("id").alias("node_id")).distinct().join(docs.select("node_id"), "node_id", "left_anti").withColumn("n", F.lit(0)))
    touched.write.mode("overwrite").parquet(f"{path}/touched/gen={gen}")


def _finish(spark: SparkSession, path: str, gen: int, docs: int, tokens: int, parts: int) -> int:
    spark.createDataFrame([(gen, docs, tokens, parts)], TOTALS).coalesce(1).write.mode("append").parquet(f"{path}/totals")
    return gen


def create(nodes: DataFrame, path: str, parts: int = 64) -> int:
    """The first generation, of all nodes (id, title, text); ids are unique. An index that is there already is an error."""
    spark = nodes.sparkSession
    if _totals(spark, path):
        raise ValueError(f"there is an index at {path}")
    _write(nodes, path, 0, parts)
    s = spark.read.parquet(f"{path}/touched/gen=0").agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    return _finish(spark, path, 0, s["docs"], s["tokens"], parts)


def change(spark: SparkSession, path: str, upserts: DataFrame, removed: DataFrame | None = None) -> int:
    """A generation more: nodes (id, title, text) that are new or replaced, and ids that go; an id in both is replaced.

    Old texts and postings are not read; the totals need the lengths of the nodes that change.
    """
    done = _totals(spark, path)
    if not done:
        raise ValueError(f"there is no index at {path}")
    last, gen = done[-1], done[-1]["gen"] + 1
    _write(upserts, path, gen, last["parts"], removed)
    own = spark.read.parquet(f"{path}/touched/gen={gen}")
    before = spark.read.parquet(f"{path}/touched").where(F.col("gen") < gen).join(own.select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.max_by("n", "gen").alias("n"))
    sums = lambda df: df.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()  # noqa: E731  one row
    new, old = sums(own), sums(before)
    return _finish(spark, path, gen, last["docs"] + new["docs"] - old["docs"], last["tokens"] + new["tokens"] - old["tokens"], last["parts"])


def found(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """(token, node_id, tf, n): the postings of some tokens as of the last finished generation."""
    last = _totals(spark, path)[-1]
    asked = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(q)), F.lit(last["parts"])).cast("int").alias(f"p{i}") for i, q in enumerate(tokens)]).first() if tokens else []
    rows = spark.read.parquet(f"{path}/postings").where(F.col("part").isin(list(asked)) & (F.col("gen") <= last["gen"]) & F.col("token").isin(tokens))
    later = spark.read.parquet(f"{path}/touched").where((F.col("gen") > 0) & (F.col("gen") <= last["gen"])).groupBy("node_id").agg(F.max("gen").alias("__at"))
    return rows.join(later, "node_id", "left").where(F.col("gen") == F.coalesce("__at", F.lit(0))).select("token", "node_id", "tf", "n")


def top(spark: SparkSession, path: str, query: list[str], k: int | None = 10, k1: float = K1, b: float = B) -> DataFrame:
    """(node_id, lexical_score): the k best by BM25, or all if k is None; ties go to the smaller id. Equal to an index made anew of what is there."""
    query, last = list(dict.fromkeys(query)), _totals(spark, path)[-1]
    rows = found(spark, path, query)
    df = rows.groupBy("token").agg(F.count("*").alias("df"))  # one row for each token of the question
    idf, tf = F.log(1 + (last["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.col("tf")
    score = idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("n") / max(1.0, last["tokens"] / max(1, last["docs"]))))
    scored = rows.join(F.broadcast(df), "token").groupBy("node_id").agg(F.sum(score).alias("lexical_score"))
    return scored if k is None else scored.orderBy(F.desc("lexical_score"), "node_id").limit(k)


def compacted(spark: SparkSession, path: str, into: str) -> int:
    """The index as it is now as one generation at another place; readers of `path` go on until they are told of it."""
    last = _totals(spark, path)[-1]
    ids = ["node_id", "gen"]
    newest = spark.read.parquet(f"{path}/touched").where(F.col("gen") <= last["gen"]).groupBy("node_id").agg(F.max("gen").alias("gen"), F.max_by("n", "gen").alias("n"))
    spark.read.parquet(f"{path}/postings").where(F.col("gen") <= last["gen"]).join(newest.select(*ids), ids, "left_semi").drop("gen").repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{into}/postings/gen=0")
    newest.where("n > 0").select("node_id", "n").write.mode("overwrite").parquet(f"{into}/touched/gen=0")
    return _finish(spark, into, 0, last["docs"], last["tokens"], last["parts"])
