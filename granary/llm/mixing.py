"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each document is wanted ``target / size of its source`` times.  The whole part is taken; the
fractional parts of a source's documents are rounded dependently: two documents exchange mass (words
times probability) at random until one of them is integral, and the one that stays fractional meets
the next.  The words taken from a source thus come within one document of its target, and every
document keeps its probability.  Documents meet in cells of some dozens; what a cell leaves
fractional meets the leftovers of other cells in the next level of a reduction tree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Scratch, places

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Fractional documents that meet in a cell, on average.
FAN_IN = 32
#: Equal rows that are made from their count at a time.
ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of sources from ``source, source_size``: by weight, at most ``cap`` times the size, the excess reshared.

    Sources in code point order, null last, weigh 5, 2, 1, repeating.  Resharing until none is above
    its cap comes to one level L, with ``target = min(cap * size, L * weight)``: sources are passed in
    the order in which a rising level would meet their caps.
    """
    weights = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("position") % len(WEIGHTS) + 1).cast("int")).cast("double")
    ranked = sizes.select("*", F.expr("row_number() over (order by source is null, cast(source as binary)) - 1").alias("position")).withColumn("weight", weights)
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("meets", F.col("most") / F.col("weight"))
    levels = ranked.select(
        "*",
        (F.expr("sum(source_size) over ()") * F.lit(share) - F.expr("sum(most) over (order by meets, position) - most")).alias("left"),
        F.expr("sum(weight) over () - sum(weight) over (order by meets, position) + weight").alias("others"),
    ).withColumn("level", F.col("left") / F.col("others"))
    levels = levels.select("*", F.expr("max(case when level <= meets then level end) over ()").alias("final"))
    return levels.select("source", "source_size", F.least("most", F.col("final") * F.col("weight")).alias("target"))


def _meet(seed: int) -> Column:
    """Lets the fractional documents of ``items`` meet one after another: the settled ones, and the one left (null for none)."""

    def step(acc: Column, item: Column) -> Column:
        held = acc["held"]
        give = F.least((F.lit(1.0) - held["p"]) * held["size"], item["p"] * item["size"])  # mass to the held one
        take = F.least(held["p"] * held["size"], (F.lit(1.0) - item["p"]) * item["size"])  # mass from it
        u = F.pmod(F.xxhash64(item["row"], held["row"], F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
        to_held = u * (give + take) < take
        held_p = F.when(to_held, held["p"] + give / held["size"]).otherwise(held["p"] - take / held["size"])
        item_p = F.when(to_held, item["p"] - give / item["size"]).otherwise(item["p"] + take / item["size"])
        held_done = F.when(to_held, (F.lit(1.0) - held["p"]) * held["size"] <= item["p"] * item["size"]).otherwise(held["p"] * held["size"] <= (F.lit(1.0) - item["p"]) * item["size"])
        settled = F.when(held_done, held.withField("p", F.when(to_held, F.lit(1.0)).otherwise(F.lit(0.0)))).otherwise(item.withField("p", F.when(to_held, F.lit(0.0)).otherwise(F.lit(1.0))))
        left = F.when(held_done, item.withField("p", item_p)).otherwise(held.withField("p", held_p))
        return F.struct(F.concat(acc["settled"], F.array(settled)).alias("settled"), left.alias("held"))

    items = F.col("items")
    start = F.struct(F.slice(items, 1, 0).alias("settled"), items[0].alias("held"))
    return F.aggregate(F.slice(items, 2, F.lit(1 << 30)), start, step)


def pivotal_round(rows: DataFrame, scratch: Scratch, seed: int = 7) -> DataFrame:
    """Rounds ``p`` of rows (``source, row, size, p`` with 0 < p < 1 and size > 0) to 0 or 1 within each source.

    ``row`` is a 64-bit hash that orders the rows and deals them to cells; rows are distinct by what
    the hash covers, so that cells hold FAN_IN rows on average whatever a source's share.
    """
    counts = scratch.write(rows.groupBy("source").agg(F.count("*").alias("n")), "counts")
    most = counts.agg(F.max("n")).first()[0] or 0
    items = rows.join(counts, rows["source"].eqNullSafe(counts["source"])).select(rows["source"], "n", F.struct("row", "size", "p", *[c for c in rows.columns if c not in ("source", "row", "size", "p")]).alias("item"))
    out = None
    for level in range(max(1, math.ceil(math.log(max(most, 2), FAN_IN)) + 1)):
        cells = F.greatest(F.lit(1), F.ceil(F.col("n") / float(FAN_IN ** (level + 1)))).cast("long")
        cell = F.pmod(F.xxhash64(F.col("item.row"), F.lit(seed)), cells)
        met = items.groupBy("source", "n", cell.alias("cell")).agg(F.sort_array(F.collect_list("item")).alias("items")).select("source", "n", "cell", _meet(seed + level).alias("met"))
        met = scratch.write(met, f"level{level}")
        settled = met.select("source", F.explode("met.settled").alias("item")).select("source", "item.*")
        out = settled if out is None else out.unionByName(settled)
        items = met.select("source", "n", F.col("met.held").alias("item"))
        if FAN_IN ** (level + 1) >= most:  # a cell for each source: what is left is one row of each
            break
    u = F.pmod(F.xxhash64("item.row", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    last = items.select("source", F.col("item").withField("p", F.when(u < F.col("item.p"), 1.0).otherwise(0.0)).alias("item")).select("source", "item.*")
    return out.unionByName(last)


def _decide(docs: DataFrame, share: float, cap: float, text: str, key: str, source: str, seed: int) -> DataFrame:
    """For each distinct ``key, source, text_hash``: ``size, source_size, target, n_rows`` and the copies ``given`` to its rows together."""
    scratch = Scratch(docs.sparkSession, "mixing")
    narrow = docs.select(docs[key].alias("key"), docs[source].alias("source"), word_count(docs[text]).alias("size"), text_hash(docs[text]).alias("text_hash"))
    rows = scratch.write(narrow.groupBy("key", "source", "size", "text_hash").agg(F.count("*").alias("n_rows")), "rows")
    sizes = scratch.write(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size")), "sizes")
    targets = scratch.write(source_targets(sizes, share, cap), "targets").withColumnRenamed("source", "its_source")
    # The targets are a written table: Spark knows its size and broadcasts it only while that is small.
    wanted = rows.join(targets, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("n_rows")
    wanted = wanted.withColumn("base", F.floor(copies)).withColumn("p", copies - F.floor(copies)).withColumn("row", F.xxhash64("key", "text_hash", "size", "source", F.lit(seed)))
    wanted = scratch.write(wanted, "wanted")
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    rounded = pivotal_round(wanted.where(open_), scratch, seed)
    u = F.pmod(F.col("row"), F.lit(1 << 52)) / float(1 << 52)
    whole = wanted.where(~open_).withColumn("p", F.when(u < F.col("p"), 1.0).otherwise(0.0))
    return rounded.select(whole.columns).unionByName(whole).withColumn("given", F.col("base") + F.col("p").cast("long"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text, text.isNull())


def _part(given: Column, rows: Column, i: Column) -> Column:
    """Copies of the ``i``-th of equal rows: as even a share as whole copies allow."""
    return F.floor(given / rows) + (i < given % rows).cast("long")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 7) -> DataFrame:
    """How many copies of each row a mix takes: ``key, source, text_hash, size, source_size, target, copies, taken``.

    A source's taken words come within one document's words of its target; no row is taken more than
    ``ceil(cap)`` times; reruns agree.  Null and empty texts have no words: they are taken as often as
    their hash decides and add nothing.  A null source is a source of its own, null keys are
    rows like any other, rows that agree in key, text and source share what they are given as evenly
    as whole copies allow, an empty table gives an empty result, and extra columns play no part.
    """
    done = _decide(docs, share, cap, text, key, source, seed)
    # Rows of a group in two steps, stretches and then rows, and the stretches of large groups are dealt anew in between.
    stretches = done.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.lit(ROWS).cast("long"))))
    dealt = stretches.where(F.col("n_rows") <= ROWS).unionByName(stretches.where(F.col("n_rows") > ROWS).repartition(F.xxhash64("key", "text_hash", "_first")))
    spread = dealt.withColumn("i", F.explode(F.sequence("_first", F.least(F.col("_first") + ROWS, "n_rows") - 1))).withColumn("copies", _part(F.col("given"), F.col("n_rows"), F.col("i")))
    return spread.select(F.col("key").alias(key), F.col("source").alias(source), "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, share: float = 1.5, cap: float = 2.0, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 7) -> DataFrame:
    """The mix itself: each row of ``docs``, all columns, as often as ``mix`` takes it.  Texts are moved once, to meet their copies."""
    given = _decide(docs, share, cap, text, key, source, seed).where("given > 0")
    given = given.select(F.col("key").alias("_key"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"), F.col("n_rows").alias("_rows"), F.col("given").alias("_given"))
    scratch = Scratch(docs.sparkSession, "mixing-take")
    given = scratch.write(given, "given")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name of a column that is added below
    plain = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    meet = lambda some: plain.join(some, plain[names[key]].eqNullSafe(F.col("_key")) & plain[names[source]].eqNullSafe(F.col("_source")) & (text_hash(plain[names[text]]) == F.col("_hash")))
    counted = meet(given.where("_rows = 1")).withColumn("_i", F.lit(0).cast("long"))
    several = given.where("_rows > 1")
    if not several.isEmpty():  # only rows that repeat another have to be numbered; a random number tells equal rows apart, so that many of them are spread
        numbered = places(meet(several).withColumn("_u", F.rand(seed)), ["_key", "_source", "_hash"], ["_u"], scratch, "repeats", "_i").drop("_u")
        counted = counted.unionByName(numbered)
    copies = _part(F.col("_given"), F.col("_rows"), F.col("_i")).cast("int")
    return counted.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*[F.col(n).alias(c) for c, n in names.items()])
