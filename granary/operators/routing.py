"""Routing questions to intents by similarity to example utterances, with a margin-gated second opinion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.retrieval import dense_top

#: Names of the six intents that the engine's tools serve.
ROUTES = ("single_lookup", "correction_analysis", "multi_compare", "calculation", "ownership_analysis", "event_analysis")


def utterances(spark, table: dict[str, list[str]]) -> DataFrame:
    """``utterance_id, route, text`` of example utterances by route."""
    rows = [(f"{route}-{i}", route, text) for route, texts in table.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "utterance_id string, route string, text string")


def route_scores(examples: DataFrame, queries: DataFrame, agg: str = "mean", top_k: int = 5) -> DataFrame:
    """``query_id, route, score``: over the ``top_k`` nearest utterances (``utterance_id, route, vec``), their mean, max or sum by route."""
    near = dense_top(examples.select(F.col("utterance_id").alias("chunk_id"), "vec"), queries, top_k, places=9)
    near = near.join(examples.select(F.col("utterance_id").alias("chunk_id"), "route"), "chunk_id")
    return near.groupBy("query_id", "route").agg({"mean": F.avg, "max": F.max, "sum": F.sum}[agg]("score").alias("score"))


def decide(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``query_id, route, score, margin``: the best route (null below the threshold) and its lead over the next."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "route")
    top = scores.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w)).where("_n = 1")
    return top.select("query_id", F.when(F.col("score") >= threshold, F.col("route")).alias("route"), "score", (F.col("score") - F.coalesce("_next", F.lit(0.0))).alias("margin"))


def cascade(first: DataFrame, second: Column | None = None, least_margin: float = 0.05) -> DataFrame:
    """Keeps answers with a route and a margin; the others get ``second`` (a model's column, computed for them only)."""
    sure = F.col("route").isNotNull() & (F.col("margin") >= least_margin)
    kept = first.where(sure).withColumn("escalated", F.lit(False))
    other = first.where(~sure).withColumn("route", second if second is not None else F.lit(None).cast("string")).withColumn("escalated", F.lit(True))
    return kept.unionByName(other)


#: The label of a model that can't tell.
UNCLEAR = "unclear"
ROUTE_PROMPT = "Classify the question by calling classify_route. If it fits several routes or none, answer with route=unclear."


def route_tool(known: tuple[str, ...] = ROUTES) -> dict:
    """The tool that a model has to call with its answer."""
    route = {"type": "string", "enum": [*known, UNCLEAR]}
    return {"name": "classify_route", "description": "Names the route of a question.", "parameters": {"type": "object", "properties": {"route": route}, "required": ["route"]}}


def model_route(client, question: str, known: tuple[str, ...] = ROUTES) -> str | None:
    """A chat model's route for a question; None if it calls nothing, is unclear, or names what isn't known."""
    reply = client.chat([{"role": "system", "content": ROUTE_PROMPT}, {"role": "user", "content": question}], [route_tool(known)])
    named = [call["arguments"].get("route") for call in reply.get("calls") or []]
    return named[0] if named and named[0] in known else None


def parse_label(answer: Column, known: tuple[str, ...] = ROUTES) -> Column:
    """A model's answer as a route: ``unclear`` and unknown labels are null."""
    return F.when(F.trim(answer).isin(*known), F.trim(answer))


def no_route(queries: DataFrame) -> DataFrame:
    return queries.withColumn("route", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double"))
