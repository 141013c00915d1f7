"""Exact removal of repeated byte strings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A string of ``LENGTH`` bytes is repeated if it starts at two places of the corpus.  The corpus is cut
for this so that equal strings meet in one task:

1. Every window of LENGTH bytes chooses the k-gram of least hash in it (its anchor).  Equal windows choose
   equal anchors.  Consecutive windows with the same anchor make a *snippet*: each window is in exactly
   one snippet, and equal windows are in snippets of equal anchors.
2. Anchors that occur once are dropped: none of their windows is repeated.
3. The distinct snippets of an anchor form a small collection.  Collections of a task are concatenated,
   and the transform of the text is expanded breadth-first: intervals of strings of length 1, 2, ... by
   backward extension give the common prefix lengths of neighbouring suffixes in increasing order.  The
   expansion stops at LENGTH: what has no value by then shares LENGTH bytes with its neighbour.
   A collection of one distinct snippet needs no expansion: it is repeated as a whole.
4. An anchor with more distinct snippets than a task should hold is split by where in the window the
   anchor stands: for half of the places, all windows share a longer string, which becomes the anchor of
   the parts.  At the last split a snippet is one window, so this ends for any input.

Texts are moved once, into a table bucketed by row; snippets of anchors that occur once never move.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Scratch, map_batches, small_batches, utf8

LENGTH = 200
#: Bytes of an anchor.
GRAM = 48
#: Windows of a text that are hashed at a time.
STRETCH = 1 << 18
#: Bytes of snippets that a task transforms at a time, and distinct snippets of an anchor beyond which it is split.
TEXT_BYTES, MOST_SNIPPETS = 1 << 20, 4096

_rng = np.random.default_rng(20)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of any substring of a stretch of bytes, by sums of coded bytes (modulo 2**64)."""

    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Hashes.powers) < n:
            size = max(n, 1 << 16)
            Hashes.powers, Hashes.inverse = _powers(_BASE, size), _powers(_INVERSE, size)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_CODE[data] * Hashes.inverse[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Hashes.powers[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * Hashes.powers[:n])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def snippets(data: np.ndarray, length: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    """(anchor, snippet hash, first window, windows, place of the anchor in the first window) for stretches of a text."""
    out = []
    for at in range(0, len(data) - length + 1, STRETCH):
        part = data[at : at + STRETCH + length - 1]
        hashes = Hashes(part)
        grams = hashes.grams(gram)
        low = np.uint64((1 << 20) - 1)
        order = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        place = (_least(order, length - gram + 1) & low).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        n = np.diff(np.concatenate((first, [len(place)])))
        out.append((grams[place[first]], hashes.of(first, first + n + length - 1), first + at, n, place[first] - first))
    return out


RECORD = "anchor long, snippet long, row long, start long, n int, place int"
_NAMES = ["anchor", "snippet", "row", "start", "n", "place"]


def _record_batch(parts: list[tuple[np.ndarray, ...]], rows: list[np.ndarray]) -> pa.RecordBatch | None:
    if not parts:
        return None
    anchor, snippet, start, n, place = (np.concatenate([p[i] for p in parts]) for i in range(5))
    columns = [pa.array(anchor.view(np.int64)), pa.array(snippet.view(np.int64)), pa.array(np.concatenate(rows)), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def records(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Snippets of ``row, text``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts, rows = [], []
        for row, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in snippets(np.frombuffer(raw.as_buffer(), np.uint8), length, gram):
                parts.append(part)
                rows.append(np.full(len(part[0]), row))
        return _record_batch(parts, rows)

    return map_batches(texts.where(F.octet_length("text") >= length).select("row", "text"), run, RECORD)


def split(texts: DataFrame, hot: DataFrame, level: int, length: int) -> DataFrame:
    """Parts of the snippets in ``hot`` by halves of the places their anchors take: their windows' common string is the new anchor."""
    size = 256 >> (level + 1)
    lists = hot.groupBy("row").agg(F.collect_list(F.struct("start", "n", "place")).alias("of"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts, rows = [], []
        for row, raw, of in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = np.frombuffer(raw.as_buffer(), np.uint8)
            for x in of:
                anchor, last = x["start"] + x["place"], x["place"] - x["n"] + 1
                origin = x["start"]
                hashes = Hashes(data[origin : x["start"] + x["n"] - 1 + length])
                for q in range(last // size, x["place"] // size + 1):
                    top, bottom = min(x["place"], q * size + size - 1), max(last, q * size)
                    begin = anchor - top
                    common = (np.array([anchor - q * size - origin]), np.array([anchor - (q * size + size - 1) + length - origin]))
                    # The place of the anchor tells apart strings that are common to different halves.
                    key = mixed(hashes.of(np.maximum(common[0], 0), common[1]) + np.uint64(level * 1024 + q))
                    n = top - bottom + 1
                    whole = hashes.of(np.array([begin - origin]), np.array([begin - origin + n - 1 + length]))
                    parts.append((key, whole, np.array([begin]), np.array([n]), np.array([top])))
                    rows.append(np.array([row]))
        return _record_batch(parts, rows)

    return map_batches(texts.join(lists.hint("shuffle_hash"), "row").select("row", "text", "of"), run, RECORD)


# ---- the transform and its expansion


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text`` (bytes + 1, separators 0 at ``ends``), each ended by its separator; equal ones by piece.

    Seven symbols are ranked first.  Then known lengths double: a suffix is ranked among those equal so
    far by the rank of what follows; only suffixes that are not yet told apart are sorted again.
    """
    n, pieces = len(text), len(ends)
    piece = np.repeat(np.arange(pieces), np.diff(np.concatenate(([-1], ends))))
    left = ends[piece] - np.arange(n)  # symbols before the separator
    key = np.zeros(n, np.int64)
    for i in range(7):
        key *= 257
        key[: max(0, n - i)] += text[i:]
    for i in range(6):  # what follows a separator doesn't count
        cut = np.flatnonzero(left == i)
        key[cut] -= key[cut] % 257 ** (6 - i)
    order = np.argsort(key)
    head = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 7
    while True:
        alone = head & np.concatenate((head[1:], [True]))
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order
        at = order[open_]
        follows = left[at] >= h
        second = piece[at].copy()  # those that have ended come first
        second[follows] = rank[at[follows] + h] + pieces
        sort = np.lexsort((second, rank[at])) if n > 1 << 30 else np.argsort(rank[at] * (n + pieces + 1) + second)
        at, second = at[sort], second[sort]
        old = rank[at]
        order[open_] = at
        new = np.concatenate(([True], (old[1:] != old[:-1]) | (second[1:] != second[:-1])))
        head[open_] = new
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        h *= 2


def shares(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each place in it whether the suffix shares ``length`` bytes with the one before."""
    order = suffix_order(text, ends)
    n = len(text)
    bwt = text[order - 1]  # a separator (0) before the start of each piece, the first one's included
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    # Runs of equal symbols: an interval within one run extends by one symbol only.
    heads = np.concatenate(([0], np.flatnonzero(bwt[1:] != bwt[:-1]) + 1))
    tails = np.concatenate((heads[1:], [n])) - 1
    run_of = np.zeros(n, np.int64)
    run_of[heads[1:]] = 1
    run_of = np.cumsum(run_of)
    symbol = bwt[heads]
    by_symbol = np.argsort(symbol, kind="stable")
    same = symbol[by_symbol[1:]] == symbol[by_symbol[:-1]]
    before, after = np.full(len(heads), -1), np.full(len(heads), len(heads))
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]

    known = np.zeros(n + 1, bool)  # whether the common prefix with the suffix before has a value yet
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n - 1])
    for value in range(length):  # intervals of strings of value + 1 bytes give the prefixes of length ``value``
        a, b = run_of[low], run_of[high]
        one = a == b
        lows, highs, symbols = [lf[low[one]]], [lf[high[one]]], [symbol[a[one]]]
        if not one.all():
            many = np.flatnonzero(~one)
            width = b[many] - a[many] + 1
            owner = np.repeat(many, width)
            run = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(a[many], width)
            first, last = before[run] < a[owner], after[run] > b[owner]
            f, g = np.flatnonzero(first), np.flatnonzero(last)
            f, g = f[np.lexsort((symbol[run[f]], owner[f]))], g[np.lexsort((symbol[run[g]], owner[g]))]
            lows.append(lf[np.maximum(low[owner[f]], heads[run[f]])])
            highs.append(lf[np.minimum(high[owner[g]], tails[run[g]])])
            symbols.append(symbol[run[f]])
        low, high, real = np.concatenate(lows), np.concatenate(highs), np.concatenate(symbols) > 0
        low, high = low[real], high[real]
        if value == 0:  # each separator is a string of its own, which ends what precedes it
            alone = np.arange(len(ends))
            low, high = np.concatenate((alone, low)), np.concatenate((alone, high))
        new = ~known[high + 1]
        low, high = low[new], high[new]
        known[high + 1] = True
        if not len(low):
            break
    return order, ~known[:n]


def repeated_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which windows of ``length`` bytes also start elsewhere in the pieces."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    ends = np.cumsum(sizes) - 1
    text = np.zeros(int(sizes.sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
    order, shared = shares(text, ends, length)
    both = shared | np.concatenate((shared[1:], [False]))
    at = np.zeros(len(text), bool)
    at[order[both]] = True
    return [at[e - s + 1 : e - length + 1] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    first = np.flatnonzero(edge == 1)
    return first, np.flatnonzero(edge == -1) - first


def expand(collections: DataFrame, length: int, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Runs of repeated windows (``anchor, snippet, first, windows``) of the snippets in ``anchor, snippet, bytes``, by anchor."""

    def solve(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        columns: list[list[int]] = [[], [], [], []]
        for (anchor, snippet, _), flags in zip(held, repeated_windows([x[2] for x in held], length), strict=True):
            for first, n in zip(*(x.tolist() for x in _runs(flags)), strict=True):
                for column, value in zip(columns, (anchor, snippet, first, n), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "snippet", "first", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for anchor, snippet, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= text_bytes and anchor != last:
                    yield solve(held)
                    held, size = [], 0
                held.append((anchor, snippet, raw))
                size, last = size + len(raw), anchor
        if held:
            yield solve(held)

    small_batches(collections.sparkSession)
    return collections.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "snippet", "bytes").mapInArrow(run, "anchor long, snippet long, first long, windows long")


def cut_out(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``anchor, snippet, bytes`` for the snippets at ``row, start, n`` in ``wanted``."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "snippet", "start", "n")).alias("of"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        anchor, snippet, pieces = [], [], []
        for raw, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for x in of:
                anchor.append(x["anchor"])
                snippet.append(x["snippet"])
                pieces.append(raw[x["start"] : x["start"] + x["n"] - 1 + length])
        return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(snippet, pa.int64()), pa.array(pieces, pa.binary())], names=["anchor", "snippet", "bytes"])

    return map_batches(texts.join(lists.hint("shuffle_hash"), "row").select("text", "of"), run, "anchor long, snippet long, bytes binary")


def repeated(texts: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, most: int = MOST_SNIPPETS) -> DataFrame:
    """``row, start, windows``: runs of window starts whose strings also start elsewhere."""
    now, marks = records(texts, length, gram), None
    for level in range(9):
        now = scratch.write(now, f"records{level}")
        anchors = scratch.write(now.groupBy("anchor").agg(F.count("*").alias("times"), (F.min("snippet") != F.max("snippet")).alias("differ")).where("times > 1"), f"anchors{level}")
        found = scratch.write(now.join(anchors.drop("times"), "anchor"), f"found{level}")
        scratch.drop(f"records{level}", f"anchors{level}")
        alike = found.where("not differ").select("row", "start", F.col("n").cast("long").alias("windows"))
        differ = found.where("differ")
        distinct = differ.groupBy("anchor", "snippet").agg(F.count("*").alias("times"), F.min(F.struct("row", "start", "n")).alias("at"))
        distinct = scratch.write(distinct.select("anchor", "snippet", "times", "at.*"), f"distinct{level}")
        sizes = distinct.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > (most if level < 8 else 1 << 62)).select("anchor")
        sizes = scratch.write(sizes, f"hot{level}")
        cool = distinct.join(sizes, "anchor", "left_anti")
        runs = expand(cut_out(texts, cool, length), length)
        runs = scratch.write(runs, f"runs{level}")
        several = cool.where("times > 1").select("anchor", "snippet", F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("windows"))
        runs = runs.join(several, ["anchor", "snippet"], "left_anti").unionByName(several)
        unlike = differ.join(runs, ["anchor", "snippet"]).select("row", (F.col("start") + F.col("first")).alias("start"), "windows")
        got = alike.unionByName(unlike)
        marks = got if marks is None else marks.unionByName(got)
        if sizes.isEmpty():
            break
        now = split(texts, differ.join(sizes, "anchor", "left_semi"), level, length)
    return marks


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST_SNIPPETS, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Removes from each row's text (as UTF-8 bytes) all bytes covered by a repeated string of ``length`` bytes.

    Returns ``key, n_bytes, n_removed, n_spans, kept_sha256`` for each row, and with ``with_text`` the
    ``kept`` bytes.  Null texts are empty; texts shorter than ``length`` lose nothing; repeated
    rows repeat each other's strings; null keys are rows like any other; an empty table gives an empty
    result; extra columns play no part.  Matches never cross rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"granary_suffix_{uuid.uuid4().hex}"
    rows = docs.select(docs[key].alias("key"), F.monotonically_increasing_id().alias("row"), utf8(docs[text]).alias("text"))
    writer = rows.repartition(buckets, "row").write.bucketBy(buckets, "row").option("compression", "zstd").option("path", scratch.path("texts"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_bytes, n_removed, n_spans, digests, texts_kept = [], [], [], [], []
        for raw, of in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            cover = np.zeros(len(raw) + 1, np.int64)
            for x in of or ():
                cover[x["start"]] += 1
                cover[x["start"] + x["windows"] - 1 + length] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(kept))
            n_spans.append(len(_runs(gone)[0]))
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts_kept.append(kept)
        columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
        names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns.append(pa.array(texts_kept, pa.binary()))
            names.append("kept")
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    try:
        writer.format("parquet").saveAsTable(table)
        texts = spark.table(table)
        marks = repeated(texts.select("row", "text"), scratch, length, gram, most)
        lists = marks.groupBy("row").agg(F.collect_list(F.struct("start", "windows")).alias("of"))
        joined = texts.join(lists.hint("shuffle_hash"), "row", "left").select("key", "text", "of")
        return scratch.write(map_batches(joined, run, schema), "result")
    finally:  # the table leaves the catalog, and all but the result the folder, however this ends
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        scratch.drop("texts", *(f"{x}{i}" for i in range(9) for x in ("records", "anchors", "found", "distinct", "hot", "runs")))
