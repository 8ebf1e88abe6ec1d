"""Incremental loading, an extension: files of nodes are merged into a table as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import upsert


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "id", order: str | None = None, buckets: int | None = None, once: bool = True):
    """JSON files in `source` are upserted into versions of the table `target`; a batch that is run again changes nothing.

    Of rows of one key in a batch the one with the largest `order` counts (of equal ones, and without it, the one with the
    largest values). Without `buckets` each batch writes the whole table as `version=n`, which suits small ones. With them
    the table is cut by a hash of the key, a batch writes only the buckets it touches, as `bucket=b/version=n`, and the
    table is the newest version of each (`current`). Versions before the last two are deleted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        best = F.max(F.struct(*([F.col(order).alias("__o")] if order else []), *[F.col(c) for c in rest])).alias("r")
        newest = batch.groupBy(key).agg(best).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
        place = F.pmod(F.xxhash64(key), F.lit(buckets or 1)).cast("int")
        touched = [r["b"] for r in newest.select(place.alias("b")).distinct().collect()] if buckets else [None]  # `buckets` rows at most
        held = _versions(s, target)
        of = lambda b, v: f"{target}/version={v}" if b is None else f"{target}/bucket={b}/version={v}"
        old = [of(b, max(v for v in held[b] if v < number)) for b in touched if any(v < number for v in held.get(b, ()))]
        merged = upsert(s.read.parquet(*old), newest, key) if old else newest
        if buckets:
            cut = merged.withColumns({"bucket": place, "version": F.lit(number)}).repartition("bucket")
            cut.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(target)
        else:
            merged.write.mode("overwrite").parquet(of(None, number))
        for b in touched:
            for v in sorted(x for x in held.get(b, ()) if x < number)[:-1]:
                _path(s, of(b, v), lambda fs, p: fs.delete(p, True))

    writer = spark.readStream.schema(schema).json(source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _path(spark: SparkSession, path: str, use):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return use(there.getFileSystem(spark._jsc.hadoopConfiguration()), there)


def _versions(spark: SparkSession, target: str) -> dict[int | None, list[int]]:
    """The versions of each bucket, or of the whole under None, by listing the folders."""
    found: dict[int | None, list[int]] = {}
    for pattern in ("version=*", "bucket=*/version=*"):
        glob = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{pattern}")
        for status in glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or ():
            above, version = str(status.getPath()).split("/")[-2:]
            bucket = int(above.split("=")[1]) if pattern.startswith("bucket") else None
            found.setdefault(bucket, []).append(int(version.split("=")[1]))
    return found


def current(spark: SparkSession, target: str) -> DataFrame:
    """The table that `follow` keeps: the newest version, of each bucket if there are any."""
    paths = [f"{target}/version={max(v)}" if b is None else f"{target}/bucket={b}/version={max(v)}" for b, v in _versions(spark, target).items()]
    return spark.read.parquet(*paths)


def event_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events (ts, event_type) counted in tumbling windows, with a watermark for late ones; for streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
