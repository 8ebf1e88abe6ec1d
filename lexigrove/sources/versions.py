"""A graph kept in versions: data files that never change, a manifest for each version, and one atomic step that makes it current.

`root/data/<uuid>/<table>/bucket=<n>` holds rows by a hash of their key. `root/versions/<n>.json` names, for each table, the
folder of each bucket. A delta writes the buckets that it touches into a new folder and takes over the others by name; then
the manifest, written aside, is renamed to its number, which fails if that number is taken. So readers see the old version
whole until the rename and the new one whole after it, a writer that dies leaves files that no manifest names, and of two
writers that start from one version the second is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import fuse
from . import sinks

#: The column whose hash deals a table's rows into buckets.
KEYS = {"nodes": "id", "edges": "source"}


class Conflict(ValueError):
    """Another writer has made the next version first."""


def _bucket(column: str, buckets: int):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _fs(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all versions, ascending."""
    there, fs = _fs(spark, f"{root}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(there)] if fs.exists(there) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, root: str, version: int | None) -> dict:
    known = versions(spark, root)
    if not known:
        raise ValueError("there is no version yet")
    version = known[-1] if version is None else version
    if version not in known:
        raise ValueError(f"no version {version}")
    return json.loads(spark.read.text(f"{root}/versions/{version}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, root: str, manifest: dict) -> int:
    """The manifest gets its number, if no other has it."""
    jvm = spark._jvm
    aside, fs = _fs(spark, f"{root}/versions/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(manifest), "utf-8"))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{manifest['version']}.json")
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # without OVERWRITE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, plain)
    except Exception as e:
        if fs.exists(target):
            fs.delete(aside, False)
            raise Conflict(f"version {manifest['version']} was made by another writer") from e
        raise
    return manifest["version"]


def _written(df: DataFrame, root: str, table: str, buckets: int, only: list[int] | None = None) -> dict[str, str]:
    """Rows in new folders by bucket (or those of some buckets): the folder of each bucket that has rows."""
    folder = f"data/{uuid.uuid4().hex}/{table}"
    rows = df.withColumn("bucket", _bucket(KEYS[table], buckets))
    rows = rows if only is None else rows.where(F.col("bucket").isin(only))
    rows.repartition(F.col("bucket")).write.partitionBy("bucket").parquet(f"{root}/{folder}")
    there, fs = _fs(df.sparkSession, f"{root}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(there)]
    return {n.removeprefix("bucket="): f"{folder}/{n}" for n in names if n.startswith("bucket=")}


def create(root: str, nodes: DataFrame, edges: DataFrame, buckets: int = 64) -> int:
    """Version 1 of a graph (nodes with id, edges with source, target, type). A root that has versions is refused."""
    spark, tables = nodes.sparkSession, {"nodes": nodes, "edges": edges}
    if versions(spark, root):
        raise Conflict("there are versions already")
    made = {name: {"schema": df.schema.jsonValue(), "folders": _written(df, root, name, buckets)} for name, df in tables.items()}
    return _publish(spark, root, {"version": 1, "buckets": buckets, "tables": made})


def _rows(spark: SparkSession, root: str, manifest: dict, table: str, only: list[int] | None = None) -> DataFrame:
    told = manifest["tables"][table]
    schema = StructType.fromJson(told["schema"])
    folders = [f"{root}/{f}" for b, f in told["folders"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a version, by default the latest. Later commits do not change what is read."""
    manifest = _manifest(spark, root, version)
    return _rows(spark, root, manifest, "nodes"), _rows(spark, root, manifest, "edges")


def commit(spark: SparkSession, root: str, delta: dict[str, DataFrame], based_on: int | None = None) -> int:
    """The next version: a delta (see `sinks.apply_delta`) on version `based_on`, by default the latest.

    Only buckets with changed rows are read in full and written; those of nodes at the ends of changed edges are read, to
    see that they exist. Raises Conflict if `based_on` is not the latest version any more.
    """
    manifest = _manifest(spark, root, based_on)
    buckets = manifest["buckets"]
    d = fuse.checked_delta(delta)
    which = lambda df, c: df.select(_bucket(c, buckets).alias("b"))
    held = lambda df: sorted(r["b"] for r in df.distinct().collect())  # noqa: E731  as many as buckets at most
    every = lambda kind, c: which(d[f"added_{kind}"], c).unionByName(which(d[f"updated_{kind}"], c)).unionByName(which(d[f"removed_{kind}"], c))
    node_buckets = held(every("nodes", "id"))
    edges = _rows(spark, root, manifest, "edges")
    gone = d["removed_nodes"].select("id").distinct()
    at = lambda end: which(edges.join(gone.withColumnRenamed("id", end), end, "left_semi"), "source")
    edge_buckets = held(every("edges", "source").unionByName(at("source")).unionByName(at("target")))
    changed = d["added_edges"].unionByName(d["updated_edges"])
    ends = held(which(changed, "source").unionByName(which(changed, "target")))
    seen = sorted({*node_buckets, *ends})
    new_nodes, new_edges = sinks.apply_delta(_rows(spark, root, manifest, "nodes", seen), _rows(spark, root, manifest, "edges", edge_buckets), delta)
    tables = {}
    for name, df, touched in (("nodes", new_nodes, node_buckets), ("edges", new_edges, edge_buckets)):
        old = manifest["tables"][name]
        fresh = _written(df.select(*[f["name"] for f in old["schema"]["fields"]]), root, name, buckets, touched) if touched else {}
        tables[name] = {"schema": old["schema"], "folders": {b: f for b, f in old["folders"].items() if int(b) not in touched} | fresh}
    return _publish(spark, root, {"version": manifest["version"] + 1, "buckets": buckets, "tables": tables})
