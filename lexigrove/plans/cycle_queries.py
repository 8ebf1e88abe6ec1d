"""Registered queries of cycles, over a graph of customers, and of holes in numbers, over their orders.

The customers of a nation and a segment stand in a row, six to a block. In two of three blocks the last leads back to the
first, in every other block the first leads to the third as well, and each block leads to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cycles, validate
from ..session import table
from .queries import query

_GRAPH = """n AS (SELECT c_custkey AS id, c_nationkey AS a, c_mktsegment AS b, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS r FROM customer),
m AS (SELECT id, a, b, r % 6 AS p, r // 6 AS k, (r // 6 + a) % 3 > 0 AS ring, (r // 6) % 2 = 0 AS chord FROM n),
e AS (SELECT x.id AS s, y.id AS t FROM m x JOIN m y ON x.a = y.a AND x.b = y.b WHERE (x.k = y.k AND (y.p = x.p + 1 OR (x.ring AND y.p = 0 AND x.p >= 2) OR (x.chord AND x.p = 0 AND y.p = 2))) OR (y.k = x.k + 1 AND x.p = 0 AND y.p = 0)),
w AS (SELECT s, t FROM e UNION SELECT w.s, e.t FROM w JOIN e ON e.s = w.t),
c AS (SELECT x.s AS node, min(x.t) AS component FROM w x JOIN w y ON y.s = x.t AND y.t = x.s GROUP BY x.s)"""


def graph(spark: SparkSession, sf: str) -> DataFrame:
    row = F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")) - 1
    n = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b"), row.alias("r"))
    block = F.floor(F.col("r") / 6)
    m = n.select("id", "a", "b", (F.col("r") % 6).alias("p"), block.alias("k"), ((block + F.col("a")) % 3 > 0).alias("ring"), (block % 2 == 0).alias("chord"))
    to = lambda p, k, when: m.where(when).select(F.col("id").alias("source"), "a", "b", p.alias("p"), k.alias("k"))
    p, k, every = F.col("p"), F.col("k"), F.lit(True)
    ways = to(p + 1, k, every).unionByName(to(F.lit(0), k, F.col("ring") & (p >= 2))).unionByName(to(F.lit(2), k, F.col("chord") & (p == 0))).unionByName(to(F.lit(0), k + 1, p == 0))
    return ways.join(m.select("a", "b", "p", "k", F.col("id").alias("target")), ["a", "b", "p", "k"]).select("source", "target")


@query(f"WITH RECURSIVE {_GRAPH} SELECT node, component FROM c")
def strong_components(spark: SparkSession, sf: str) -> DataFrame:
    """The customers on cycles, and the cycle's smallest."""
    return cycles.strong_components(graph(spark, sf))


@query(f"""WITH RECURSIVE {_GRAPH}, i AS (SELECT e.s, e.t, x.component FROM e JOIN c x ON x.node = e.s JOIN c y ON y.node = e.t AND y.component = x.component),
g AS (SELECT component, [component] AS path, component AS at, false AS done FROM c WHERE node = component
  UNION ALL SELECT g.component, list_append(path, i.t), i.t, i.t = g.component FROM g JOIN i ON i.s = g.at WHERE NOT done AND (i.t = g.component OR NOT list_contains(path, i.t)))
SELECT component, array_to_string(path, ' ') AS path FROM g WHERE done QUALIFY row_number() OVER (PARTITION BY component ORDER BY len(path), path) = 1""")
def closed_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The shortest closed path from the smallest customer of each cycle."""
    edges = graph(spark, sf)
    return cycles.closed_paths(edges, cycles.strong_components(edges)).select("component", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"))


# --- gaps as intervals ------------------------------------------------------------------------------------------------
_MARKED = "o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey + CASE WHEN o_orderkey % 5 > 2 THEN 1000000000 * (1 + o_custkey % 3) ELSE 0 END AS v FROM orders)"


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as the clauses of an article; some numbers jump by a billion and more, so holes lie on both sides."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = k + F.when(k % 5 > 2, F.lit(1_000_000_000).cast("long") * (1 + c % 3)).otherwise(0)
    return table(spark, sf, "orders").select(c.cast("string").alias("parent_id"), F.lit("CLAUSE").alias("type"), number.alias("number"), F.lit(None).cast("string").alias("marker"), F.lit("").alias("title"), k.alias("start_idx"))


@query(f"""WITH {_MARKED}, f AS (SELECT c, arg_min(v, k) AS low, arg_max(v, k) AS high FROM o GROUP BY c HAVING count(*) > 1), i AS (SELECT DISTINCT c, v FROM o JOIN f USING (c) WHERE v BETWEEN low AND high),
h AS (SELECT c, v, lead(v) OVER (PARTITION BY c ORDER BY v) AS n FROM i) SELECT c::VARCHAR AS parent_id, v + 1 AS low, n - 1 AS high FROM h WHERE n > v + 1""")
def gap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """The holes in the numbers of each customer's orders, those of a billion numbers among them."""
    return validate.gap_intervals(_marked(spark, sf)).select("parent_id", "low", "high")


@query(f"""WITH {_MARKED}, f AS (SELECT c, arg_min(v, k) AS low, arg_max(v, k) AS high FROM o GROUP BY c HAVING count(*) > 1), i AS (SELECT DISTINCT c, v FROM o JOIN f USING (c) WHERE v BETWEEN low AND high),
h AS (SELECT c, v, lead(v) OVER (PARTITION BY c ORDER BY v) AS n FROM i), g AS (SELECT c, v + 1 AS low, n - 1 AS high FROM h WHERE n > v + 1),
t AS (SELECT c, low, least(high, 499999999) AS high FROM g UNION ALL SELECT c, greatest(low, 1000000001), high FROM g) SELECT c::VARCHAR AS parent_id, low, high FROM t WHERE low <= high""")
def gaps_outside(spark: SparkSession, sf: str) -> DataFrame:
    """What of the holes lies outside the numbers from half a billion to a billion."""
    holes = validate.gap_intervals(_marked(spark, sf))
    middle = holes.select("parent_id", F.lit(500_000_000).cast("long").alias("low"), F.lit(1_000_000_000).cast("long").alias("high")).distinct()
    return validate.interval_difference(holes, middle, ["parent_id"])
