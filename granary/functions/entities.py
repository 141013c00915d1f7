"""Companies, periods, metrics and report names in questions; placeholders for companies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T

SPANS = "array<struct<begin:int,end:int,corp:string>>"


def aliases(universe: DataFrame) -> DataFrame:
    """``alias, corp`` from company master rows: the names and the names they go by."""
    names = universe.select(T.nfc("corp_name").alias("corp"), T.nfc("listed_name").alias("listed"))
    listed = names.where(F.col("listed").isNotNull() & (F.col("listed") != "") & (F.col("listed") != F.col("corp"))).select(F.col("listed").alias("alias"), "corp")
    return names.select(F.col("corp").alias("alias"), "corp").unionByName(listed).where(F.col("alias") != "").distinct()


def by_length(table: list[tuple[str, str]]) -> list[tuple[int, dict[str, str]]]:
    """Aliases with their companies, by length, the longest first; of equal aliases the last company counts."""
    out: dict[int, dict[str, str]] = {}
    for alias, corp in sorted(set(table)):
        out.setdefault(len(alias), {})[alias] = corp
    return sorted(out.items(), reverse=True)


def find_spans(text: str | None, names: list[tuple[int, dict[str, str]]]) -> list[tuple[int, int, str]]:
    """Mentions that don't overlap, in the order of the text: longer aliases before shorter ones, then from left to right.

    For each length of an alias every stretch of the text is looked up; what is taken is marked on a mask of the text.
    """
    text = text or ""
    free = bytearray(b"\1" * len(text))
    found = []
    for size, known in names:
        for at in range(len(text) - size + 1):
            corp = known.get(text[at : at + size])
            if corp is not None and all(free[at : at + size]):
                free[at : at + size] = bytes(size)
                found.append((at, at + size, corp))
    return sorted(found)


def company_spans(text: Column | str, table: list[tuple[str, str]]) -> Column:
    """Mentions of the companies in ``table`` (alias, company), which holds the company master and thus is small."""
    names = by_length(table)

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"begin": b, "end": e, "corp": c} for b, e, c in find_spans(t, names)])

    return spans(T.col(text))


def extract(questions: DataFrame, table: list[tuple[str, str]], terms: list[str], text: str = "query") -> DataFrame:
    """Adds ``entities`` (companies, company_count, period, metrics, report_name, explicit_correction, company_spans)."""
    rows = questions.withColumn("_nfc", T.nfc(text)).withColumn("_spans", company_spans("_nfc", table))
    companies = F.array_distinct(F.transform("_spans", lambda s: s["corp"]))
    return rows.withColumn(
        "entities",
        F.struct(
            companies.alias("companies"), F.size(companies).alias("company_count"), T.periods("_nfc").alias("period"), T.metrics("_nfc", terms).alias("metrics"),
            T.report_name("_nfc").alias("report_name"), T.mentions_correction("_nfc").alias("explicit_correction"), F.col("_spans").alias("company_spans"),
        ),
    ).drop("_spans", "_nfc")


ENTITIES = "struct<companies:array<string>,company_count:int,period:array<string>,metrics:array<string>,report_name:string,explicit_correction:boolean,company_spans:array<struct<begin:int,end:int,corp:string>>>"


def with_model(extracted: DataFrame, model: Column) -> DataFrame:
    """``entities`` by rule, and where the rules find no company, period or metric, what a model says instead.

    ``model`` is a column of a model's answers as JSON with the fields of ``entities``; what isn't JSON says nothing.  It alone without
    rules: pass rows whose ``entities`` are null.
    """
    said = F.from_json(model, ENTITIES)
    has = lambda c: F.size(F.coalesce(c, F.array())) > 0
    held = lambda name: F.when(has(F.col("entities")[name]), F.col("entities")[name]).otherwise(F.coalesce(said[name], F.array().cast("array<string>")))
    companies = held("companies")
    return extracted.withColumn(
        "entities",
        F.struct(
            companies.alias("companies"), F.size(companies).alias("company_count"), held("period").alias("period"), held("metrics").alias("metrics"), F.coalesce(F.col("entities.report_name"), said["report_name"]).alias("report_name"),
            F.coalesce(F.col("entities.explicit_correction"), said["explicit_correction"], F.lit(False)).alias("explicit_correction"), F.coalesce(F.col("entities.company_spans"), F.array().cast(SPANS)).alias("company_spans"),
        ),
    )


def normalized(text: Column, spans: Column) -> Column:
    """The text with companies as ``[COMPANY]``, or numbered in order of first mention if there are several mentions."""
    order = F.array_distinct(F.transform(spans, lambda s: s["corp"]))
    mark = lambda s: F.when(F.size(spans) > 1, F.concat(F.lit("[COMPANY_"), F.array_position(order, s["corp"]).cast("string"), F.lit("]"))).otherwise(F.lit("[COMPANY]"))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    end = F.aggregate(spans, start, lambda a, s: F.struct(F.concat(a["done"], F.substring(text, a["at"] + 1, s["begin"] - a["at"]), mark(s)).alias("done"), s["end"].alias("at")))
    return F.concat(end["done"], F.substring(text, end["at"] + 1, F.length(text)))
