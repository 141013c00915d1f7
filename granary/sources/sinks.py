"""Sinks: chunks, vectors and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def vectors(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Vectors and their payload, by report type."""
    rows.write.mode(mode).partitionBy("report_type").parquet(path)


def append_remaining(rows: DataFrame, path: str, key: str = "chunk_id", max_rows: int = 20_000) -> int:
    """Appends what ``path`` doesn't hold yet, in files of a bounded number of rows: an interrupted job goes on where it stopped."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows.write.mode("append").option("maxRecordsPerFile", max_rows).parquet(path)
    return spark.read.parquet(path).count()


def table_csv(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def stage_report(config: DataFrame, metrics: DataFrame, results: DataFrame, failures: DataFrame, path: str) -> None:
    """The files of an evaluation stage."""
    json_lines(config, f"{path}/config")
    json_lines(metrics, f"{path}/metrics")
    table_csv(results, f"{path}/results", "overwrite")
    json_lines(failures, f"{path}/failure_cases")
