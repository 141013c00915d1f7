"""Checks of answers against their evidence, and of a corpus against its manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T

#: Evidence numbers beyond which derived numbers are not tried, unless the caller says otherwise.
MOST_NUMBERS = 200
KEYWORD = "근거"


def derived(claimed: Column, evidence: Column, most: int | None = MOST_NUMBERS) -> Column:
    """The first expression over two evidence numbers that gives the claimed one: a - b, a + b, or a / b in percent.

    Tolerance: half a percent of the claimed number, 0.5 at least.  With ``most``, nothing is
    tried against more evidence numbers than that; None tries all pairs of any number.
    """
    target = claimed.try_cast("double")
    tolerance = F.greatest(F.abs(target) * 0.005, F.lit(0.5))
    near = lambda v: F.coalesce(F.abs(v - target) <= tolerance, F.lit(False))

    def pair(a: Column, b: Column) -> Column:
        x, y = a.try_cast("double"), b.try_cast("double")
        return (
            F.when(a == b, F.lit(None))
            .when(near(x - y), F.concat(a, F.lit(" - "), b))
            .when(near(x + y), F.concat(a, F.lit(" + "), b))
            .when(near(x / F.nullif(y, F.lit(0.0)) * 100), F.concat(a, F.lit(" / "), b, F.lit(" * 100(%)")))
        )

    found = F.flatten(F.transform(evidence, lambda a: F.array_compact(F.transform(evidence, lambda b: pair(a, b)))))
    first = F.try_element_at(found, F.lit(1))
    return first if most is None else F.when(F.size(evidence) <= most, first)


def validate(answers: DataFrame, most_numbers: int | None = MOST_NUMBERS) -> DataFrame:
    """Adds ``validation`` to rows of ``answer, prompt_text, tool_results (strings), citations (report_id, chunk_id, is_correction), explicit_correction``."""
    none = F.array().cast("array<string>")
    tools = F.coalesce("tool_results", none)
    evidence = F.array_distinct(F.concat(T.numbers("prompt_text"), F.flatten(F.transform(tools, lambda t: T.numbers(t)))))
    rows = answers.withColumn("_evidence", evidence).withColumn("_open", F.array_except(T.numbers("answer"), F.col("_evidence")))
    rows = rows.withColumn("_derived", F.transform("_open", lambda n: F.struct(n.alias("number"), derived(n, F.col("_evidence"), most_numbers).alias("by"))))
    ungrounded = F.transform(F.filter("_derived", lambda d: d["by"].isNull()), lambda d: d["number"])
    named = F.flatten(F.transform(tools, lambda t: T.doc_ids(t)))
    cited = F.coalesce(F.exists("citations", lambda c: F.contains(F.col("answer"), c["report_id"]) | F.contains(F.col("answer"), c["chunk_id"])), F.lit(False))
    anything = (F.size(F.coalesce("citations", F.array())) > 0) | (F.size(named) > 0)
    has_citation = anything & (cited | F.exists(named, lambda d: F.contains(F.col("answer"), d)) | F.contains(F.col("answer"), F.lit(KEYWORD)))
    both = F.coalesce(F.exists("citations", lambda c: c["is_correction"]), F.lit(False)) & F.coalesce(F.exists("citations", lambda c: ~F.coalesce(c["is_correction"], F.lit(False))), F.lit(False))
    complete = F.when(F.coalesce("explicit_correction", F.lit(False)), both)
    grounded = F.size(ungrounded) == 0
    return rows.withColumn(
        "validation",
        F.struct(
            grounded.alias("numbers_grounded"), ungrounded.alias("ungrounded_numbers"), F.map_from_entries(F.filter("_derived", lambda d: d["by"].isNotNull())).alias("verified_derived_numbers"),
            has_citation.alias("has_citation"), complete.alias("correction_evidence_complete"), (grounded & has_citation & F.coalesce(complete, F.lit(True))).alias("passed"),
            F.array_compact(F.array(F.when(~grounded, F.lit("ungrounded numbers")), F.when(anything & ~has_citation, F.lit("no citation")), F.when(~F.coalesce(complete, F.lit(True)), F.lit("correction evidence incomplete")))).alias("warnings"),
        ),
    ).drop("_evidence", "_open", "_derived")


def faithfulness(validated: DataFrame) -> DataFrame:
    """Shares of grounded, cited and passed answers."""
    rate = lambda c: F.avg(F.col(f"validation.{c}").cast("double"))
    return validated.agg(rate("numbers_grounded").alias("faithfulness"), rate("has_citation").alias("citation_rate"), rate("passed").alias("pass_rate"), F.count("*").alias("n"))


def name_report(names: DataFrame, found: DataFrame, key: str = "name") -> DataFrame:
    """``name, status`` of names on either side: matched, missing (no folder) or extra (no name)."""
    a, b = names.select(key).distinct(), found.select(key).distinct()
    return (
        a.join(b, key, "left_semi").withColumn("status", F.lit("matched"))
        .unionByName(a.join(b, key, "left_anti").withColumn("status", F.lit("missing")))
        .unionByName(b.join(a, key, "left_anti").withColumn("status", F.lit("extra")))
    )


def resolution_report(rows: DataFrame, group: str = "doc_group", resolved: str = "resolved", healthy: float = 0.99) -> DataFrame:
    """Totals by group; a group is healthy from a share of 0.99 resolved.  ``failures`` has the rows that aren't."""
    out = rows.groupBy(group).agg(F.count("*").alias("total"), F.count_if(resolved).alias("n_resolved"))
    rate = F.when(F.col("total") > 0, F.col("n_resolved") / F.col("total")).otherwise(F.lit(0.0))
    return out.withColumn("rate", rate).withColumn("healthy", F.col("rate") >= healthy)


def failures(rows: DataFrame, group: str = "doc_group", resolved: str = "resolved", key: str = "doc_id") -> DataFrame:
    """``group, key`` of what isn't resolved, a row each."""
    return rows.where(~F.coalesce(F.col(resolved), F.lit(False))).select(group, key)
