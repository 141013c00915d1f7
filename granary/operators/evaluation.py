"""Metrics of rankings and of classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.storage import cut

FALLBACK = "__fallback__"


def per_query(ranked: DataFrame, gold: DataFrame, k: int = 10, item: str = "report_id") -> DataFrame:
    """``query_id, recall, rr, ndcg, hit`` for each query of ``gold`` (``query_id, gold`` array), from ``query_id, rank, item``.

    An item counts at its first rank only.  Queries without gold items score 0, those without results too.
    """
    first = ranked.groupBy("query_id", item).agg(F.min("rank").alias("rank"))
    wanted = gold.select("query_id", F.array_distinct("gold").alias("gold"))
    met = wanted.select("query_id", F.explode("gold").alias(item)).join(first, ["query_id", item])
    hits = met.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias("dcg")
    )
    n = F.size("gold")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return wanted.join(hits, "query_id", "left").select(
        "query_id", zero(F.when(n > 0, F.col("found") / n)).alias("recall"), zero(1 / F.col("first")).alias("rr"), zero(F.when(n > 0, F.col("dcg") / ideal)).alias("ndcg"),
        F.coalesce(F.col("found") > 0, F.lit(False)).alias("hit"),
    )


def ordered_value(rows: DataFrame, by: str, value: str, place: Column) -> DataFrame:
    """``by, n, value``: of each group's values in order the one at ``place`` (from 0, by the group's number of values ``n``); nulls don't count.

    Groups and values are sorted together over all partitions, so that a group of any size is spread: a value's place is
    its place among all less that of its group's first.
    """
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    slim = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).alias("v"))
    spread = cut(slim.repartitionByRange(int(parts), "g", "v").sortWithinPartitions("g", "v").withColumn("m", F.monotonically_increasing_id()))
    spread = spread.select("g", "v", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("within"))
    # What partitions hold of each group: where each group goes on in each partition.
    held = spread.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("within").alias("first"))
    w = Window.partitionBy("g").orderBy("part")
    held = held.select("g", "part", "first", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    wanted = held.select(F.col("g").alias("g2"), F.col("part").alias("part2"), "total", (place.cast("long") - F.col("before") + F.col("first")).alias("within2"))
    wanted = cut(wanted)
    met = spread.join(wanted, F.col("g").eqNullSafe(F.col("g2")) & (F.col("part") == F.col("part2")) & (F.col("within") == F.col("within2")))
    return met.select(F.col("g").alias(by), F.col("total").alias("n"), F.col("v").alias(value))


def p95(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``by, n, value``: of n sorted values the one at max(0, floor(0.95 n) - 1), counted from 0."""
    return ordered_value(rows, by, value, F.greatest(F.floor(F.col("total") * 0.95) - 1, F.lit(0)))


def summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return scores.groupBy(*(by or [])).agg(mean("recall").alias("recall"), mean("rr").alias("mrr"), mean("ndcg").alias("ndcg"), mean(F.col("hit").cast("double")).alias("hit_rate"), F.count("*").alias("n"))


def confusion(rows: DataFrame, true: str = "expected", predicted: str = "predicted") -> DataFrame:
    """``t, p, n`` of labels; null is the fallback label."""
    return rows.groupBy(F.coalesce(true, F.lit(FALLBACK)).alias("t"), F.coalesce(predicted, F.lit(FALLBACK)).alias("p")).agg(F.count("*").alias("n"))


def classification(rows: DataFrame, true: str = "expected", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """``accuracy, macro_f1, fallback_rate, n``: F1 averaged over the labels on either side, 0 where it has no denominator."""
    by = by or []
    cells = rows.groupBy(*by, F.coalesce(true, F.lit(FALLBACK)).alias("t"), F.coalesce(predicted, F.lit(FALLBACK)).alias("p")).agg(F.count("*").alias("n"), F.count_if(F.col(predicted).isNull()).alias("none"))
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("claimed"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("right")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("claimed"), F.lit(0).cast("long").alias("right")))).alias("x")).select(*by, "x.*")
    labels = sides.groupBy(*by, "label").agg(F.sum("actual").alias("actual"), F.sum("claimed").alias("claimed"), F.sum("right").alias("right"))
    f1 = 2 * F.col("right") / (F.col("actual") + F.col("claimed"))
    macro = labels.groupBy(*by).agg(F.avg(f1).alias("macro_f1"))
    overall = cells.groupBy(*by).agg((F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), (F.sum("none") / F.sum("n")).alias("fallback_rate"), F.sum("n").alias("n"))
    joined = overall.join(macro, by) if by else overall.crossJoin(macro)  # one row each
    return joined.select(*by, "accuracy", "macro_f1", "fallback_rate", "n")


def ambiguous(rows: DataFrame, acceptable: str = "acceptable", predicted: str = "predicted") -> DataFrame:
    """Shares of appropriate answers (fallbacks included), fallbacks, and wrong ones."""
    none = F.col(predicted).isNull()
    fine = none | F.array_contains(acceptable, F.col(predicted))
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return rows.agg(F.count("*").alias("n"), rate(fine).alias("appropriate_rate"), rate(none).alias("fallback_rate"), rate(~fine).alias("forced_wrong_rate"))


def threshold_sweep(scored: DataFrame, thresholds: list[float], true: str = "expected", label: str = "route", score: str = "score") -> DataFrame:
    """Classification at each threshold from scores made once: below it the label is null."""
    each = scored.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return classification(each.withColumn("predicted", F.when(F.col(score) >= F.col("threshold"), F.col(label))), true, by=["threshold"])


def set_scores(predicted: Column, gold: Column) -> Column:
    """``exact, f1`` of two sets; two empty ones agree."""
    both = F.size(F.array_intersect(predicted, gold))
    total = F.size(F.array_distinct(predicted)) + F.size(F.array_distinct(gold))
    return F.struct((F.size(F.array_except(predicted, gold)) + F.size(F.array_except(gold, predicted)) == 0).alias("exact"), F.when(total == 0, 1.0).otherwise(2 * both / total).alias("f1"))


def verdict(error: Column, grounded: Column, citation: Column) -> Column:
    return F.when(error.isNotNull(), "FAIL").when(F.coalesce(grounded, F.lit(False)) & F.coalesce(citation, F.lit(False)), "PASS").otherwise("FAIL")


def batch_summary(results: DataFrame, by: str) -> DataFrame:
    """Counts, pass rate and mean time by a column, most frequent first."""
    out = results.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "PASS").alias("n_pass"), F.count_if(F.col("error").isNotNull()).alias("n_error"), F.avg("elapsed").alias("mean_elapsed"))
    return out.withColumn("pass_rate", F.col("n_pass") / F.col("n")).orderBy(F.desc("n"), by)


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that isn't done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def first_gold(ranked: DataFrame, gold: DataFrame, item: str = "report_id") -> DataFrame:
    """The first rank of each gold item."""
    met = ranked.join(gold, ["query_id", item])
    return met.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", item).orderBy("rank"))).where("_n = 1").drop("_n")
