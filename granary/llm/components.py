"""Connected components of a distributed graph by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Scratch


def _least(edges: DataFrame, scratch: Scratch, step: str) -> DataFrame:
    """``a, m``: the smallest neighbour of each node.  Written, so that the join with it can split a node of many edges."""
    return scratch.write(edges.groupBy("a").agg(F.min("b").alias("m")), step)


def connected(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for each node with an edge in ``a, b``: the smallest node of its component.

    Every round is written to the shared folder.  Rounds grow with the logarithm of the component
    size; no node's neighbours are ever gathered.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    edges = scratch.write(edges.where("a <> b").select(big.alias("a"), small.alias("b")).distinct(), "edges0")
    before = None
    for i in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _least(both, scratch, f"large{i}").withColumn("m", F.least("a", "m"))
        wide = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        wide = scratch.write(wide, f"wide{i}")
        low = _least(wide, scratch, f"small{i}")
        joined = wide.join(low, "a")
        edges = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = scratch.write(edges, f"edges{i + 1}")
        scratch.drop(f"edges{i}", f"large{i}", f"wide{i}", f"small{i}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("connected components did not settle")
