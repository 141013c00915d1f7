"""Structured Streaming: chunks that arrive as files, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.operators.retrieval import last_by_key
from granary.storage import cut, remove


def file_stream(spark: SparkSession, path: str, schema: str, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _versions(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """The versions that each bucket of a table has, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    if fs.exists(root):
        for found in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/bucket=*/version=*")):
            parts = found.getPath().toString().split("/")
            out.setdefault(int(parts[-2].removeprefix("bucket=")), []).append(int(parts[-1].removeprefix("version=")))
    return {bucket: sorted(versions) for bucket, versions in out.items()}


def current(spark: SparkSession, target: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of an upserted table, as of the last version (before ``before``) of each of its buckets; None without any."""
    paths = []
    for bucket, versions in _versions(spark, target).items():
        held = [v for v in versions if before is None or v < before]
        if held and (buckets is None or bucket in buckets):
            paths.append(f"{target}/bucket={bucket}/version={held[-1]}")
    return spark.read.parquet(*paths) if paths else None


def upsert(stream: DataFrame, target: str, checkpoint: str, key: str = "chunk_id", order: str = "filing_date", transform: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 16) -> StreamingQuery:
    """Keeps the row of the greatest ``order`` of each key, in whichever batch it comes; of equal ones a later batch's counts.

    Keys are dealt to buckets.  A batch writes a new version of those buckets only that it has keys of, from their last version and
    its own rows, and drops all versions but the one before.  A batch that is run again gives the same versions.  ``current`` reads the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = last_by_key(transform(batch) if transform else batch, key, order)
        rows = cut(rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # as many as there are buckets at most
        if not touched:
            return
        old = current(spark, target, number, touched)
        both = rows.withColumn("_batch", F.lit(1))
        if old is not None:
            both = both.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).withColumn("_batch", F.lit(0)))
        w = Window.partitionBy(key).orderBy(F.desc_nulls_last(order), F.desc("_batch"))
        last = both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_batch").withColumn("version", F.lit(number))
        last.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(target)
        for bucket, versions in _versions(spark, target).items():
            for version in versions[:-2] if bucket in touched else ():
                remove(spark, f"{target}/bucket={bucket}/version={version}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by window; rows later than the watermark are dropped by the stream.  Works on batches too."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", by: str = "user_id") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
