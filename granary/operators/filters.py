"""Metadata filters of retrieval, as predicates that reach the scan."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RetrievalFilter:
    """Conjunction of conditions; an empty list and None set none.

    ``dense_compat`` gives the stricter reading of vector stores: a null ``is_latest`` fails
    ``latest_only``, and ``report_ids`` is ignored.
    """

    report_ids: list[str] = field(default_factory=list)
    companies: list[str] = field(default_factory=list)
    doc_groups: list[str] = field(default_factory=list)
    doc_subtypes: list[str] = field(default_factory=list)
    periods: list[str] = field(default_factory=list)
    filing_date_from: str | None = None
    filing_date_to: str | None = None
    latest_only: bool = False
    include_corrections: bool = True

    def predicate(self, dense_compat: bool = False) -> Column:
        out = F.lit(True)
        if self.report_ids and not dense_compat:
            out &= F.col("report_id").isin(self.report_ids)
        if self.companies:
            out &= F.col("company").isin([unicodedata.normalize("NFC", c) for c in self.companies])
        for name, values in (("report_type", self.doc_groups), ("report_subtype", self.doc_subtypes), ("period", self.periods)):
            if values:
                out &= F.col(name).isin(values)
        date = F.coalesce("filing_date", F.lit(""))
        if self.filing_date_from:
            out &= date >= self.filing_date_from
        if self.filing_date_to:
            out &= (F.col("filing_date") if dense_compat else date) <= self.filing_date_to
        if self.latest_only:
            out &= F.col("is_latest") if dense_compat else F.coalesce("is_latest", F.lit(True))
        if not self.include_corrections:
            out &= ~F.coalesce("is_correction", F.lit(False))
        return out


def apply(chunks: DataFrame, flt: RetrievalFilter | None, dense_compat: bool = False) -> DataFrame:
    return chunks if flt is None else chunks.where(flt.predicate(dense_compat))


def vector_payload(chunks: DataFrame) -> DataFrame:
    """What a vector store keeps beside a vector: the metadata, and the filing date as a number."""
    return chunks.select(
        "chunk_id", "report_id", "company", "corp_code", "report_type", "report_subtype", "report_name", "period", "filing_date", F.expr("try_cast(filing_date as int)").alias("filing_date_int"),
        "section_path", "content_type", "is_correction", "correction_group_id", "correction_order", "is_latest",
    )


def evidence(ranked: DataFrame) -> DataFrame:
    """What a search tool shows of a hit; the score to four places."""
    return ranked.select(
        "query_id", "rank", "chunk_id", "report_id", "company", "report_name", "report_type", "period", "filing_date", "section_path", "is_correction", "is_latest", "text", F.round("score", 4).alias("score")
    )


def relaxations(company: str | None = None, report_type: str | None = None, period: str | None = None, latest_only: bool = True) -> list[RetrievalFilter]:
    """Filters to try in turn: all conditions, then without period, without latest-only, without type.  The company stays."""
    one = lambda x: [x] if x else []
    steps = [RetrievalFilter(companies=one(company), doc_groups=one(report_type), periods=one(period), latest_only=latest_only)]
    if period:
        steps.append(RetrievalFilter(companies=one(company), doc_groups=one(report_type), latest_only=latest_only))
    if latest_only:
        steps.append(RetrievalFilter(companies=one(company), doc_groups=one(report_type)))
    if report_type:
        steps.append(RetrievalFilter(companies=one(company)))
    return steps


def weakest(steps: list[RetrievalFilter]) -> Column:
    """What every step asks: the last step's conditions, since each step drops some of those before it."""
    return steps[-1].predicate()


def first_step(steps: list[RetrievalFilter]) -> Column:
    """The number of the first step that a row passes; null if there is none."""
    return F.coalesce(*[F.when(s.predicate(), F.lit(i)) for i, s in enumerate(steps)])


def first_nonempty(ranked: DataFrame, steps: list[RetrievalFilter], k: int, key: str = "query_id") -> DataFrame:
    """Of each query's candidates, the best ``k`` of the first step that leaves any; ``attempt`` says which.

    All steps are decided in one pass: the steps that a row passes are an array, the first step of a query
    a window minimum.
    """
    passes = F.array_compact(F.array(*[F.when(s.predicate(), F.lit(i)) for i, s in enumerate(steps)]))
    rows = ranked.withColumn("_steps", passes).where(F.size("_steps") > 0)
    first = rows.groupBy(key).agg(F.min(F.array_min("_steps")).alias("attempt"))
    rows = rows.join(first, key).where(F.array_contains("_steps", F.col("attempt"))).drop("_steps")
    return rows.withColumn("rank", F.expr(f"row_number() over (partition by {key} order by score desc, chunk_id)")).where(F.col("rank") <= k)
