"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected at random to some dimensions, shifted, and put in the order of a Hilbert curve;
several projections and shifts give several orderings.  Each ordering is cut into ranges of nearly
equal numbers of rows.  A query meets the rows of its own range and of the neighbouring ones, in every
ordering; what it meets is ranked by coarse codes, and what the codes can't exclude is merged over the orderings
and reranked by the exact measure.

How wide the windows are follows from the data: for a bounded sample of queries the nearest rows are found by an exact scan, and
the window is the narrowest in which RECALL of these pairs meet in some ordering.  Vectors with structure get
narrow windows; among vectors in all directions alike, no small window holds the nearest ones.  A range with more rows
than a task should hold is dealt to cells, each of which meets the range's queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Scratch, map_batches

ORDERINGS, DIMENSIONS, GRID = 48, 20, 2
#: Ranges to either side of a query's own that it meets; rows of a range at least, and ranges of an ordering at most.
REACH, LEAST, MOST_RANGES = 2, 4, 4096
#: Vectors on which projections and the bounds of ranges are fitted; queries on which the windows are, and the share of their nearest rows that windows have to hold.
SAMPLE, TRIED, RECALL = 8192, 128, 0.94
#: Rows and queries that a cell holds.
CELL = 4096
#: Decimal places to which scores are compared: beyond them they differ by rounding only, and the smaller id comes first.
PLACES = 12


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with ``bits`` bits a coordinate (Skilling, 2004)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):  # undo the turns of the finer cells: invert, or exchange with the first axis
            on = (x[i] & q) != 0
            exchange = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, exchange)
            if i:
                x[i] ^= exchange
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass
class Curves:
    axes: list[np.ndarray] = field(default_factory=list)  # vector dimension x DIMENSIONS, for each ordering
    grids: list[np.ndarray] = field(default_factory=list)  # DIMENSIONS x bounds of the grid's cells
    sorted: list[np.ndarray] = field(default_factory=list)  # the sample's keys
    bounds: list[np.ndarray] = field(default_factory=list)  # keys at which ranges begin

    @classmethod
    def fit(cls, sample: np.ndarray, orderings: int, seed: int = 11) -> Curves:
        rng = np.random.default_rng(seed)
        out = cls()
        for o in range(orderings):
            axes = np.linalg.qr(rng.normal(size=(sample.shape[1], min(DIMENSIONS, sample.shape[1]))))[0]
            shift = rng.uniform(0, 1 / (1 << GRID))  # moves the grid, and with it what the curve cuts apart
            levels = (np.arange(1, 1 << GRID) / (1 << GRID) + shift).clip(0, 1)
            out.axes.append(axes)
            out.grids.append(np.quantile(sample @ axes, levels, axis=0).T)
            out.sorted.append(np.sort(out.keys(sample, o)))
        return out

    def cut(self, ranges: int) -> None:
        """Cuts each ordering into ranges that hold equal parts of the sample."""
        self.bounds = [keys[(np.arange(1, ranges) * len(keys)) // ranges] for keys in self.sorted]

    def keys(self, vectors: np.ndarray, ordering: int) -> np.ndarray:
        projected = vectors @ self.axes[ordering]
        cells = np.stack([np.searchsorted(g, c, side="right") for g, c in zip(self.grids[ordering], projected.T, strict=True)], axis=1)
        return hilbert_keys(cells, GRID)

    def places(self, vectors: np.ndarray, ordering: int) -> np.ndarray:
        """Where in the ordering vectors lie, from 0 to 1, as far as the sample tells."""
        keys = self.keys(vectors, ordering)
        return (np.searchsorted(self.sorted[ordering], keys, side="left") + np.searchsorted(self.sorted[ordering], keys, side="right")) / (2 * len(self.sorted[ordering]))

    def ranges(self, vectors: np.ndarray, ordering: int) -> np.ndarray:
        return np.searchsorted(self.bounds[ordering], self.keys(vectors, ordering), side="right")


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two (which is exact), so that no square of theirs over- or underflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def unpacked(raw: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in raw])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def window(curves: Curves, pairs: list[tuple[np.ndarray, np.ndarray]], recall: float) -> float:
    """The least distance in an ordering (as a share of all rows, to either side) within which that share of the pairs lies in some ordering."""
    if not pairs:
        return 0.0
    a, b = (np.stack(side) for side in zip(*pairs, strict=True))
    apart = np.min([np.abs(curves.places(a, o) - curves.places(b, o)) for o in range(len(curves.axes))], axis=0)
    return float(np.quantile(apart, recall, method="higher"))


PACKED = "key long, dir binary, vec binary"


def _pack(rows: DataFrame) -> DataFrame:
    """``key``, the vector as packed doubles, and a hash of its direction (to PLACES decimals): multiples of a vector have the same."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = scaled(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)) + 0.0
        steps = np.rint(unit(x) * 2.0**40).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(d.tobytes()) for d in steps], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["key", "dir", "vec"])

    return map_batches(rows, run, PACKED)


def _exact(rows: DataFrame, tried: list, k: int) -> DataFrame:
    """``q, id, vec, score``: of each batch of ``id, vec`` the ``k`` nearest to each of the few vectors ``tried``, other than themselves."""
    asked = unit(unpacked([r.vec for r in tried]))
    names = np.array([r.id for r in tried])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy()
        scores = asked @ unit(unpacked(batch.column(1).to_pylist())).T
        scores[names[:, None] == ids[None, :]] = -2
        best = np.argsort(-scores, axis=1)[:, :k]
        q, at = np.repeat(np.arange(len(names)), best.shape[1]), best.ravel()
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[at]), batch.column(1).take(pa.array(at)), pa.array(scores[q, at])], names=["q", "id", "vec", "score"])

    return map_batches(rows.select("id", "vec"), run, "q long, id long, vec binary, score double").where("score > -2")


PLACED = "place long, id long, code binary"


@dataclass
class Cells:
    """Numbers of cells: an ordering's range, one of the parts its rows are dealt to, one of those its queries are, and whether it is a row."""

    rows: np.ndarray  # parts of the rows, ordering x range
    queries: np.ndarray  # parts of the queries that meet there

    def number(self, o: int, r: np.ndarray, row_part: np.ndarray, query_part: np.ndarray, is_row: bool) -> np.ndarray:
        n = self.rows.shape[1]
        return ((((o * n + r) * int(self.rows.max()) + row_part) * int(self.queries.max()) + query_part) << 1) | int(is_row)


def _encode(x: np.ndarray, least: np.ndarray) -> list[bytes]:
    """Unit vectors in bytes, each with its step, the length of what rounding lost, and the score that what it meets has to have at least."""
    step = np.abs(x).max(axis=1, keepdims=True) / 127
    codes = np.rint(x / step)
    lost = np.linalg.norm(x - codes * step, axis=1)
    head = np.stack((step[:, 0], lost, least), axis=1).astype(np.float64)
    return [h.tobytes() + c.tobytes() for h, c in zip(head, codes.astype(np.int8), strict=True)]


def _decode(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    head = np.stack([np.frombuffer(v, np.float64, 3) for v in raw])
    codes = np.stack([np.frombuffer(v, np.int8, offset=24) for v in raw]).astype(np.float32)
    return codes * head[:, :1].astype(np.float32), head[:, 1], head[:, 2]


def _spread(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)


def _crowds(vectors: DataFrame, curves: Curves, reach: int, cell: int) -> np.ndarray:
    """For each ordering and range, to how many parts the vectors that come there are dealt: one, unless they are more than a cell holds."""
    orderings, n = len(curves.axes), len(curves.bounds[0]) + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = unit(unpacked(batch.column(0).to_pylist()))
        counts = np.zeros((orderings, n + 2 * reach), np.int64)
        for o in range(orderings):
            own = curves.ranges(x, o)
            for step in range(2 * reach + 1):
                np.add.at(counts[o], own + step, 1)
        o, r = np.nonzero(counts[:, reach : reach + n])
        return pa.RecordBatch.from_arrays([pa.array(o), pa.array(r), pa.array(counts[o, r + reach])], names=["o", "r", "n"])

    crowded = map_batches(vectors.select("vec"), run, "o long, r long, n long").groupBy("o", "r").agg(F.sum("n").alias("n")).where(F.col("n") > cell)
    out = np.ones((orderings, n), np.int64)
    for row in crowded.collect():  # as many as there are ranges at most
        out[row.o, row.r] = -(-row.n // cell)
    return out


def _place(vectors: DataFrame, curves: Curves, cells: Cells, reach: int, sample: np.ndarray | None = None, k: int = 0) -> DataFrame:
    """``id, vec`` in each ordering: a row in its own range and one of its parts, for each part of the queries; a query near each range, for each part of the rows.

    Queries are those for which a ``sample`` of rows is given: the score of the ``k``-th nearest of these is one that each of the
    ``k`` nearest rows has.
    """
    is_row = sample is None
    n = cells.rows.shape[1]
    own_parts, other_parts = (cells.rows, cells.queries) if is_row else (cells.queries, cells.rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy()
        x = unit(unpacked(batch.column(1).to_pylist()))
        least = np.full(len(x), -2.0)
        if not is_row and len(sample) >= k:
            least = np.partition(x @ sample.T, len(sample) - k, axis=1)[:, len(sample) - k] - 1e-9
        codes, spread = pa.array(_encode(x, least), pa.binary()), _spread(ids).astype(np.int64)
        places, ats = [], []
        for o in range(len(curves.axes)):
            own = curves.ranges(x, o)
            for step in (0,) if is_row else range(-reach, reach + 1):
                at = np.flatnonzero((own + step >= 0) & (own + step < n))
                r = own[at] + step
                mine, others = spread[at] % own_parts[o, r], other_parts[o, r]
                for copy in range(int(others.max(initial=0))):
                    held = others > copy
                    other = np.full(held.sum(), copy)
                    pair = (mine[held], other) if is_row else (other, mine[held])
                    places.append(cells.number(o, r[held], *pair, is_row))
                    ats.append(at[held])
        at = pa.array(np.concatenate(ats))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(places)), batch.column(0).take(at), codes.take(at)], names=["place", "id", "code"])

    return map_batches(vectors.select("id", "vec"), run, PLACED)


def _candidates(placed: DataFrame, k: int) -> DataFrame:
    """``q, v``: in each cell, for each query, the rows that may be among the ``k`` nearest, by what the codes' rounding leaves open."""

    def solve(queries: list, rows: list) -> pa.RecordBatch | None:
        if not queries or not rows:
            return None
        q, q_lost, least = _decode([x[1] for x in queries])
        d, d_lost, _ = _decode([x[1] for x in rows])
        near = (q @ d.T).astype(np.float64)
        open_ = q_lost[:, None] + d_lost[None, :] * (1 + q_lost[:, None]) + 1e-5  # how far off a product of codes can be
        n = min(k, len(rows))
        sure = np.partition(near - open_, len(rows) - n, axis=1)[:, len(rows) - n]  # n rows are at least as near
        a, b = np.nonzero(near + open_ >= np.maximum(sure, least)[:, None])
        qid, vid = np.array([x[0] for x in queries]), np.array([x[0] for x in rows])
        return pa.RecordBatch.from_arrays([pa.array(qid[a]), pa.array(vid[b])], names=["q", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, rows = None, [], []
        for batch in batches:
            for place, i, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place >> 1 != cell:
                    if (out := solve(queries, rows)) is not None:
                        yield out
                    cell, queries, rows = place >> 1, [], []
                (rows if place & 1 else queries).append((i, code))
        if (out := solve(queries, rows)) is not None:
            yield out

    return placed.mapInArrow(run, "q long, v long")


def _scored(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``score``: the cosine of their vectors ``a`` and ``b`` in double precision, instead of the vectors."""
    rest = [f for f in pairs.schema.fields if f.name not in ("a", "b")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        score = cosines(unpacked(held["a"].to_pylist()), unpacked(held["b"].to_pylist()))
        return pa.RecordBatch.from_arrays([*(held[f.name] for f in rest), pa.array(score)], names=[*(f.name for f in rest), "score"])

    return map_batches(pairs, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "score double"]))


def nearest(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, orderings: int = ORDERINGS, reach: int = REACH, cell: int = CELL, sample: int = SAMPLE, tried: int = TRIED, recall: float = RECALL, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found of each row that ``is_query`` picks, by cosine in double precision.

    Scores are those of the original vectors and compared to PLACES decimals; ties go to the smaller id; all candidates are returned
    if fewer.  Rows with a null id and vectors that are null, zero, of another length than the most frequent one, or hold null or
    non-finite components take no part.  Vectors of one direction (copies and multiples of each other) tie with each other for every
    query, so they are indexed once with their smallest ids, and thousands of them crowd out nothing; a repeated row counts
    once.  Empty tables give an empty result; extra columns play no part.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hilbert")
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("x")).where(F.col("key").isNotNull() & F.col("x").isNotNull())
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(finite & F.exists("x", lambda c: c != 0))
    length = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("x") == (length.n if length else 0))

    valid = scratch.write(_pack(rows), "valid")
    low = valid.dropDuplicates(["key", "vec"]).select("*", F.expr("row_number() over (partition by dir order by key, vec)").alias("n")).where(F.col("n") <= k + 1)
    low = scratch.write(low.drop("n"), "low")
    distinct = scratch.write(low.groupBy("dir").agg(F.min_by("vec", F.struct("key", "vec")).alias("vec"), F.min("key").alias("least")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    asked = scratch.write(valid.where(F.expr(is_query.replace(key, "key"))).dropDuplicates(["key", "vec"]), "asked")
    queries = scratch.write(distinct.join(asked.select("dir").distinct(), "dir", "left_semi"), "queries")
    n, m = distinct.count(), queries.count()
    if not n or not m:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")

    got = distinct.where(F.pmod(F.xxhash64("dir"), F.lit(1 << 30)) / float(1 << 30) < min(1.0, sample / n)).select("dir", "vec").orderBy("dir").limit(2 * sample).collect() or distinct.select("vec").limit(sample).collect()
    known = unit(unpacked([r.vec for r in got]))
    curves = Curves.fit(known, orderings)
    few = queries.orderBy(F.xxhash64("dir"), "dir").limit(tried).select("id", "vec").collect()
    true = _exact(distinct, few, k).withColumn("n", F.expr("row_number() over (partition by q order by score desc, id)")).where(F.col("n") <= k).collect()  # tried * k at most
    half = window(curves, [(unit(unpacked([few[r.q].vec]))[0], unit(unpacked([r.vec]))[0]) for r in true], recall)
    ranges = int(np.clip((reach + 0.5) / max(half, 1e-9), 1, max(1, min(MOST_RANGES, n // LEAST))))
    curves.cut(ranges)

    cells = Cells(_crowds(distinct, curves, 0, cell), _crowds(queries, curves, reach, cell))
    placed = _place(distinct, curves, cells, reach).unionByName(_place(queries, curves, cells, reach, known, k + 1))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.withColumn("cell", F.shiftright("place", 1)).repartition(parts, "cell").drop("cell").sortWithinPartitions("place")
    found = scratch.write(_candidates(dealt, k + 1).distinct(), "found")
    q, v = queries.select(F.col("id").alias("q"), F.col("vec").alias("a")), distinct.select(F.col("id").alias("v"), "least", F.col("vec").alias("b"))
    best = _scored(found.join(v, "v").join(q, "q"))
    best = best.withColumn("n", F.expr(f"row_number() over (partition by q order by round(score, {PLACES}) desc, least, v)")).where(F.col("n") <= k + 1)
    # Directions become rows again: each with its own vector, against the query's own.
    best = scratch.write(best.select("q", "v"), "best")
    near = low.join(distinct.select("dir", F.col("id").alias("v")), "dir").select("v", F.col("key").alias("near"), F.col("vec").alias("b"))
    mine = asked.join(queries.select("dir", F.col("id").alias("q")), "dir").select("q", "key", F.col("vec").alias("a"))
    answers = _scored(mine.join(best, "q").join(near, "v").where("key <> near").select("key", "near", "a", "b", F.xxhash64("a").alias("vector")))
    ranked = answers.withColumn("rank", F.expr(f"row_number() over (partition by key, vector order by round(score, {PLACES}) desc, near)")).where(F.col("rank") <= k)
    return ranked.select(F.col("key").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("near").alias(key), "score")
