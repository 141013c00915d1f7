"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_stored: dict[tuple, tuple[str, object]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Only a session on one machine may do without: it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="granary-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a written table: a plan that grows by the round is cut, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def state_of(df: DataFrame) -> tuple:
    """The files that a table consists of, with their sizes and times: what is derived from it holds as long as these do."""
    spark = df.sparkSession
    out = []
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


def stored(source: DataFrame, name: str, make: Callable[[str], object]):
    """What ``make`` stores under the path it is given, made once in a session for each state of the source's files; made again if the path is gone."""
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, name, state_of(source))
    if key not in _stored or not exists(spark, _stored[key][0]):
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _stored[key] = path, make(path)
    return _stored[key][1]
