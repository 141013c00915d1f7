"""Sources: manifests, company masters, term lists, gold sets, file listings and raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import schema
from granary.functions.text import nfc

NFC_COLUMNS = ("corp_name", "listed_name", "flr_nm", "file_path")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines of filings; names and paths in normal form C, absent values by their defaults."""
    rows = spark.read.schema(schema.MANIFEST).option("mode", "PERMISSIVE").json(path)
    rows = rows.where(F.col("doc_id").isNotNull())
    for name in NFC_COLUMNS:
        rows = rows.withColumn(name, nfc(name))
    return rows.fillna({"report_nm": "", "is_correction": False, "file_format": "xml", "n_files": 1})


def universe(spark: SparkSession, path: str) -> DataFrame:
    """The company master: CSV, all strings (codes keep leading zeros), with or without a byte order mark."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("inferSchema", False).csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    for name in ("corp_name", "listed_name"):
        if name in rows.columns:
            rows = rows.withColumn(name, nfc(name))
    return rows


def terms(spark: SparkSession, path: str) -> DataFrame:
    """``position, term``: lines but for blank ones and comments, in order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("position", "line"))
    return lines.where((F.trim("line") != "") & ~F.col("line").startswith("#")).select("position", F.trim("line").alias("term"))


def utterances(spark: SparkSession, path: str) -> DataFrame:
    """``utterance_id, route, text`` of example utterances: lines of a route and a text, tab-separated; blank ones and comments are skipped."""
    parts = terms(spark, path).select("position", F.split("term", "\t", 2).alias("p")).where(F.size("p") == 2)
    numbered = parts.select(F.col("p")[0].alias("route"), F.trim(F.col("p")[1]).alias("text"), "position")
    return numbered.select(F.concat_ws("-", "route", F.expr("row_number() over (partition by route order by position) - 1")).alias("utterance_id"), "route", "text")


def user_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``word, tag, score`` from tab-separated lines; tag NNG and score 0 where absent."""
    parts = terms(spark, path).select("position", F.split("term", "\t").alias("p"))
    return parts.select(F.col("p")[0].alias("word"), F.coalesce(F.get("p", F.lit(1)), F.lit("NNG")).alias("tag"), F.coalesce(F.get("p", F.lit(2)).try_cast("double"), F.lit(0.0)).alias("score"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects."""
    return spark.read.option("multiLine", True).json(path)


def shard_scan(spark: SparkSession, path: str, companies: list[str]) -> DataFrame:
    """Chunks of some companies; the condition reaches the Parquet scan."""
    return spark.read.parquet(path).where(F.col("company").isin(companies))


def overrides(spark: SparkSession, dates: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(dates.items()), "doc_id string, target_date string")


def raw_files(spark: SparkSession, root: str, glob: str = "*.xml") -> DataFrame:
    """``path, folder, name, stem, content`` of files under a folder, through Spark's reader."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(F.col("path"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "content")


def main_files(files: DataFrame, filings: DataFrame) -> DataFrame:
    """Each filing's files with ``is_main``: the file named after the receipt number, else the first by name is the main one.

    A filing's folder ends with its logical path, both in normal form C: every ending of a folder's name is a key that
    the paths are joined on.  Files are ranked by their names; contents are joined to those at the end.
    """
    logical = filings.select("doc_id", "doc_group", "doc_subtype", "file_format", "rcept_no", nfc("file_path").alias("_logical"))
    parts = F.split(nfc("folder"), "/")
    endings = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda i: F.array_join(F.slice("_parts", i, F.size("_parts")), "/"))
    names = files.select("path", "stem", "name", parts.alias("_parts")).select("path", "stem", "name", F.explode(endings).alias("_logical"))
    met = names.join(logical, "_logical")
    first = F.expr("row_number() over (partition by doc_id order by stem = rcept_no desc, name)")
    ranked = met.select("path", "doc_id", "doc_group", "doc_subtype", "file_format", "rcept_no", (first == 1).alias("is_main"))
    return files.join(ranked, "path")


def resolve(paths: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """Logical paths against listed ones, both in normal form C: ``path, actual, n_actual``; several actual paths are a collision."""
    seen = listing.select(F.col(key).alias("actual"), nfc(key).alias("_k")).groupBy("_k").agg(F.min("actual").alias("actual"), F.count_distinct("actual").alias("n_actual"))
    return paths.withColumn("_k", nfc(key)).join(seen, "_k", "left").drop("_k").withColumn("n_actual", F.coalesce("n_actual", F.lit(0)))


#: Names that a diagnosis lists.
SIBLINGS = 20


def unresolved(paths: DataFrame, listing: DataFrame, key: str = "path", most: int = SIBLINGS) -> DataFrame:
    """Why paths aren't found: ``path, failed_at`` (number of the first part that nothing listed has), ``failed_part`` and ``siblings``, the first ``most`` names that are there instead."""
    begins = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("_parts", 1, i - 1), "/").alias("above"), F.element_at("_parts", i).alias("part")))
    parts = lambda df: df.select(key, F.split(nfc(key), "/").alias("_parts")).select(key, F.explode(begins).alias("x")).select(key, "x.*")
    there, asked = parts(listing).drop(key).distinct(), parts(paths)
    missing = asked.join(there, ["depth", "above", "part"], "left_anti").groupBy(key).agg(F.min(F.struct("depth", "above", "part")).alias("x")).select(key, "x.*")
    names = there.withColumn("_n", F.expr("row_number() over (partition by depth, above order by part)")).where(F.col("_n") <= most)
    siblings = names.groupBy("depth", "above").agg(F.array_sort(F.collect_list("part")).alias("siblings"))
    out = missing.join(siblings, ["depth", "above"], "left")
    return out.select(key, (F.col("depth") - 1).alias("failed_at"), F.col("part").alias("failed_part"), F.coalesce("siblings", F.array().cast("array<string>")).alias("siblings"))


def folders(listing: DataFrame, depth: int = 0, key: str = "path") -> DataFrame:
    """Distinct names of folders at a depth; names that begin with a dot are skipped."""
    name = nfc(F.get(F.split(key, "/"), F.lit(depth)))
    return listing.select(name.alias("name")).where(F.col("name").isNotNull() & ~F.col("name").startswith(".")).distinct()
