"""Minimax contiguous partition of ordered atomic groups into shards.

Groups (rows of equal text) are ordered by a digest of the text.  The smallest capacity at which a
greedy walk over the ordered group sizes needs no more than the wanted shards is found by binary
search, and the cuts are made at that capacity.

The group sizes never come to the driver.  The driver holds the sizes of *segments* of the digest
order, and splits (by one small distributed aggregation a round) only those segments in which a cut
of a still possible capacity may lie: at most a few hundred rows for each shard and round, at any
input size.  With segments taken as atomic the walk gives a capacity that surely works; with cuts
anywhere inside a segment one that is surely needed.  When both agree the answer is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Scratch, utf8

#: Hex digits by which a round of refinement lengthens the prefix of a segment (16**2 parts).
DIGITS = 2
#: Hex digits of the first segments (16**3 of them).
FIRST = 3
HEX = 64


@dataclass
class Segments:
    """Ordered segments of the digest order: their first prefixes, running totals of size, and whether they are one group."""

    prefixes: list[str]
    sizes: list[int]
    single: list[bool]

    def __post_init__(self) -> None:
        self.ends = [0]
        for x in self.sizes:
            self.ends.append(self.ends[-1] + x)

    @property
    def total(self) -> int:
        return self.ends[-1]

    def cut_known(self, limit: int) -> int:
        """Index of the last known boundary at or below ``limit``."""
        return bisect_right(self.ends, limit) - 1

    def cut_most(self, limit: int) -> int:
        """No boundary of groups at or below ``limit`` lies higher than this."""
        k = self.cut_known(limit)
        return self.ends[k] if k >= len(self.sizes) or self.single[k] else min(limit, self.ends[k + 1])

    def walk(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy cuts (indices of boundaries) with segments atomic, or None if the shards don't suffice."""
        cuts, at = [0], 0
        for _ in range(shards):
            k = self.cut_known(self.ends[at] + capacity)
            cuts.append(k)
            if k == len(self.sizes):
                return cuts
            if k == at:
                return None
            at = k
        return None

    def reach(self, capacity: int, shards: int) -> list[int]:
        """Upper bounds (in size) of the greedy cuts."""
        out, at = [], 0
        for _ in range(shards):
            at = self.cut_most(at + capacity)
            out.append(at)
        return out


def search(segments: Segments, shards: int) -> tuple[int, int, list[int]]:
    """The largest capacity that surely fails (plus one), the smallest that surely works, and the segments to split between them."""
    low, high = 0, max(segments.total, 0)
    a, b = low, high
    while a < b:  # smallest with atomic segments
        mid = (a + b) // 2
        if segments.walk(mid, shards) is not None:
            b = mid
        else:
            a = mid + 1
    works = b
    a, b = low, works
    while a < b:  # smallest that isn't refuted
        mid = (a + b) // 2
        if segments.reach(mid, shards)[-1] >= segments.total:
            b = mid
        else:
            a = mid + 1
    needed = b
    split: set[int] = set()
    if needed < works:
        least, at = [], 0
        for _ in range(shards):  # lower bounds of the cuts at the capacity that isn't refuted
            at = segments.ends[segments.cut_known(at + needed)]
            least.append(at)
        for lo, hi in zip(least, segments.reach(works, shards), strict=True):
            first, last = max(0, bisect_right(segments.ends, lo) - 1), min(len(segments.sizes), bisect_left(segments.ends, hi) + 1)
            split.update(k for k in range(first, last) if not segments.single[k] and segments.sizes[k])
    return needed, works, sorted(split)


def even_cuts(segments: Segments, capacity: int, shards: int) -> list[int]:
    """Cuts that keep to the capacity and, within it, lie nearest to equal shares of what is left.

    The greedy walk fills the first shards and leaves the last ones short; each cut here stays
    between the first boundary from which the rest still fits and the last one that the capacity allows.
    """
    n = len(segments.sizes)
    first = [n]  # smallest boundary from which i shards of the capacity reach the end
    for _ in range(shards):
        first.append(bisect_left(segments.ends, segments.ends[first[-1]] - capacity))
    cuts = [0]
    for i in range(shards):
        at, left = cuts[-1], shards - i
        lo, hi = max(at, first[left - 1]), segments.cut_known(segments.ends[at] + capacity)
        goal = segments.ends[at] + (segments.total - segments.ends[at]) / left
        k = bisect_left(segments.ends, goal)
        if k > 0 and (k > n or goal - segments.ends[k - 1] <= segments.ends[k] - goal):
            k -= 1
        cuts.append(min(max(k, lo), hi))
    cuts[-1] = n
    return cuts


def _sizes(groups: DataFrame, digits: int, within: list[tuple[str, int]] | None) -> list[tuple[str, int, bool]]:
    rows = groups
    if within is not None:
        of_length: dict[int, list[str]] = {}
        for prefix, _ in within:
            of_length.setdefault(len(prefix), []).append(prefix)
        wanted = F.lit(False)
        for length, prefixes in of_length.items():
            wanted = wanted | F.substring("digest", 1, length).isin(prefixes)
        rows = rows.where(wanted)
    out = rows.groupBy(F.substring("digest", 1, digits).alias("p")).agg(F.sum("size").alias("s"), (F.min("digest") == F.max("digest")).alias("one"))
    return [(r.p, r.s, r.one) for r in out.collect()]


def partition(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Capacity and the digests (prefixes) at which shards 1, 2, ... begin.

    ``groups`` has ``digest`` (hex of HEX digits) and ``size`` on each row; rows of a digest form a group.
    """
    found = sorted(_sizes(groups, FIRST, None))
    digits = FIRST
    while True:
        segments = Segments([x[0] for x in found], [x[1] for x in found], [x[2] or len(x[0]) >= HEX for x in found])
        needed, works, split = search(segments, shards)
        if needed >= works or not split:
            break
        digits = min(HEX, digits + DIGITS)
        fine = sorted(_sizes(groups, digits, [(found[k][0], k) for k in split]))
        gone = set(split)
        found = sorted([x for k, x in enumerate(found) if k not in gone] + fine)
    cuts = even_cuts(segments, works, shards)
    return works, [segments.prefixes[k] if k < len(segments.prefixes) else "~" for k in cuts[1:-1]]


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id", overhead: int = 16, cell_rows: int = 4096) -> DataFrame:
    """Assigns every row to a shard so that the largest shard is as small as contiguous, unbroken groups allow.

    Returns ``key, size, text_crc32, law, shard, slot, grown_shard`` for each row.  Law ``bytes``:
    sizes (UTF-8 bytes plus ``overhead``) are near equal, as far as the largest group of equal texts
    lets them be.  A null text is a text of no bytes, and all null and all empty texts are one group;
    null keys are rows like any other, repeated rows keep their number, an empty table gives an
    empty result, and extra columns of the input play no part.  ``slot`` numbers the rows of a shard from 0
    without gaps; which row of a shard gets which number is not defined.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    raw = utf8(docs[text])
    narrow = docs.select(docs[key].alias("key"), (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("digest"))
    rows = scratch.write(narrow, "rows")
    _, starts = partition(rows, shards)
    shard: Column = F.lit(0)
    for start in starts:  # as many as shards less one; an empty shard's start equals the next one's
        shard = shard + (F.col("digest") >= F.lit(start)).cast("int")
    placed = rows.withColumn("shard", shard).drop("digest")
    # Slots: rows of a shard are dealt to cells of a few thousand rows, cells are counted, and each
    # row adds its number within its cell to the rows of the cells before it.
    n = placed.groupBy("shard").count().withColumn("cells", F.ceil(F.col("count") / cell_rows).cast("int")).collect()
    cells = F.coalesce(*[F.when(F.col("shard") == r.shard, F.lit(r.cells)) for r in n], F.lit(1)) if n else F.lit(1)
    dealt = scratch.write(placed.withColumn("cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), cells).cast("int")), "dealt")
    scratch.drop("rows")
    counts = dealt.groupBy("shard", "cell").count().select("shard", "cell", F.expr("sum(count) over (partition by shard order by cell) - count").alias("before"))
    numbered = dealt.select("*", F.expr("row_number() over (partition by shard, cell order by size, text_crc32, key) - 1").alias("within"))
    return numbered.join(counts, ["shard", "cell"]).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def shard_of(docs: DataFrame, shards: int = 40, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the ``shard`` of each row (in place of a column of that name), as a stage of a pipeline needs it; texts are not shuffled.

    Nulls, repeats and empty tables: as in ``shard_documents``.
    """
    raw = utf8(docs[text])
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.write(docs.select((F.octet_length(raw) + F.lit(16)).cast("long").alias("size"), F.sha2(raw, 256).alias("digest")), "rows")
    _, starts = partition(rows, shards)
    scratch.drop("rows")
    if not starts:
        return docs.withColumn("shard", F.lit(0))
    # The digest is an element of an array, so that it is computed once a row and not for every boundary.
    shards_of = F.transform(F.array(F.sha2(raw, 256)), lambda digest: F.size(F.filter(F.array(*[F.lit(x) for x in starts]), lambda x: x <= digest)))
    return docs.withColumn("shard", shards_of[0])
