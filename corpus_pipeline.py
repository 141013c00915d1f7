"""A corpus pipeline: quality, near-duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``.  All stages but the last return the columns of documents, extra ones
included; the last adds ``shard``, in place of a column of that name.

Null and empty texts are texts of nothing: the classifier scores them as such, they are one group of near-duplicates, hold no test
items, are mixed without adding words, and share a shard.  Null ids are ids like any other, but aren't learnt from; a null source is
a source.  Of rows equal in id and text one stays.  Texts of any length are read whole.  Empty tables pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontam, mixing, quality, sharding, simhash
from granary.llm.common import Scratch, begun, cleanup, fold, read

def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = read(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    return quality.keep(docs, quality.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, at a five-word Jaccard similarity of 0.8 or more, stays."""
    return simhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out of the texts that hold them; ``n_chars`` follows."""
    clean = decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return sharding.shard_of(docs)


STAGES = [("quality", filter_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("sharding", shard)]

#: SQL can't express a trained classifier; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        mark = begun(spark)
        try:
            docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        finally:  # the stage's own tables, whether it ended well or not
            cleanup(spark, mark)
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
