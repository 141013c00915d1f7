"""What the operators of this subpackage share: durable intermediate tables, Arrow mapping and bounded samples."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.storage import remove, shared_folder

#: Rows an Arrow batch holds: texts can be long, and a Python worker holds a batch at a time.
BATCH_ROWS = 512


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    ``write`` stores a frame as Parquet and returns a frame that reads it; ``drop`` removes those
    tables that later steps no longer need.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _roots.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def path(self, step: str) -> str:
        return f"{self.root}/{step}"

    def write(self, df: DataFrame, step: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(step))
        return self.spark.read.schema(df.schema).parquet(self.path(step))

    def drop(self, *steps: str) -> None:
        for step in steps:
            remove(self.spark, self.path(step))


#: Folders of all intermediate tables of an application, in the order in which they were begun.
_roots: dict[str, list[str]] = {}


def begun(spark: SparkSession) -> int:
    """A mark for ``cleanup``: how many folders of intermediate tables there are."""
    return len(_roots.get(spark.sparkContext.applicationId, []))


def cleanup(spark: SparkSession, since: int = 0) -> None:
    """Removes the intermediate tables begun since a mark.  Results that are read from them have to be stored or done with by then."""
    roots = _roots.get(spark.sparkContext.applicationId, [])
    for root in roots[since:]:
        remove(spark, root)
    del roots[since:]


def places(df: DataFrame, by: list[str], order: list[str | Column], scratch: Scratch, step: str, name: str = "place") -> DataFrame:
    """``df`` with the place of each row in its group, from 0, in the given order; rows of one group lie in a row in all orders that begin with ``by``.

    All groups are sorted together over all partitions, so that a group of any size is spread: a row's place follows from its
    place in its partition and the rows of its group in the partitions before.  Nulls are equal.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    spread = scratch.write(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()), f"{step}-spread")
    spread = spread.withColumn("_part", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    held = spread.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), (before - F.col("_first")).alias("_before"))
    held = scratch.write(held, f"{step}-held")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return spread.join(held, same).select(*df.columns, (F.col("_at") + F.col("_before")).alias(name))


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small, unless the session asks for something else than the default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``function`` over each Arrow batch: stateless, so any task can be run again."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def utf8(text: Column | str) -> Column:
    """The text as bytes, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % parts


def spare(df: DataFrame, name: str = "_text") -> str:
    """A name that no column of ``df`` has."""
    return name + "_" * max([0, *(len(c) for c in df.columns if c.startswith(name))])


def share_of(hashed: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, features: Callable[[bytes], bytes], key: str, text: str, longest: int | None = None) -> tuple[list[int], list[bytes], dict[int, int]] | None:
    """Labels and features of a bounded sample of labelled texts, the same ones at every run, and how many keys have each label; None without both labels.

    A key that is marked 0 and 1 isn't learnt from, and one that is marked repeatedly counts once, as do equal rows of
    ``docs``.  Of each label at most ``sample`` texts are taken (of at most ``longest`` bytes, if that is given): those of the smallest hashes of
    key and text, among keys picked by a hash.  Only features travel.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("z")).where("y = z")
    counts = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    # Somewhat more keys than are taken, so that hardly ever fewer than the sample are left: their number is bounded by the sample.
    room = sample + 4 * math.sqrt(sample) + 20
    picked = marks.select("k", "y").where(share_of(F.xxhash64("k", F.lit("sample"))) < F.when(F.col("y") == 1, min(1.0, room / counts[1])).otherwise(min(1.0, room / counts[0])))
    rows = docs.select(F.col(key).alias("k"), utf8(text).alias("raw"))
    rows = rows if longest is None else rows.where(F.octet_length("raw") <= longest)
    rows = rows.join(F.broadcast(picked), "k").select("y", F.xxhash64("k", "raw").alias("h"), "raw")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array([features(raw) for raw in batch.column(2).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], made], names=["y", "h", "x"])

    made = map_batches(rows, run, "y int, h long, x binary").dropDuplicates(["y", "h"])
    got = made.withColumn("n", F.expr("row_number() over (partition by y order by h)")).where(F.col("n") <= sample).select("y", "h", "x").toArrow()
    got = sorted(zip(*(c.to_pylist() for c in got.columns), strict=True))
    ys = [y for y, _, _ in got]
    return (ys, [x for _, _, x in got], counts) if len(set(ys)) == 2 else None


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
