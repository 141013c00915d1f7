"""The offline plan: filings to chunks and the index, as one lazy graph of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import chunks, validation, versions
from granary.sources import files, parsers


@dataclass
class Corpus:
    filings: DataFrame  # manifest with version columns
    nodes: DataFrame
    chunks: DataFrame
    leaves: DataFrame
    health: DataFrame
    failures: DataFrame  # filings without a file


def build(spark: SparkSession, manifest_path: str, root: str, only: list[str] | None = None, overrides: dict[str, str] | None = None) -> Corpus:
    """All chunks of a corpus.  Versions are resolved over the full manifest even if only some filings are chunked."""
    manifest = files.manifest(spark, manifest_path)
    raw = files.raw_files(spark, root)
    ours = files.main_files(raw, manifest)
    found = manifest.join(ours.select("doc_id").distinct().withColumn("resolved", F.lit(True)), "doc_id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    texts = ours.where("is_main").select("doc_id", parsers.flat_text("content", F.col("doc_group") == "exchange").alias("text"))
    fixed = files.overrides(spark, overrides) if overrides else None
    index = versions.correction_index(manifest, texts, fixed)
    filings = manifest.drop("is_correction").join(index, "doc_id")
    wanted = ours if only is None else ours.where(F.col("doc_id").isin(only))
    nodes = parsers.parse(wanted)
    made = chunks.chunk(nodes, filings)
    return Corpus(filings, nodes, made, chunks.leaves(made), validation.resolution_report(found), validation.failures(found))
