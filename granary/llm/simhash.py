"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments.  If two fingerprints differ in at most ``radius`` bits, they differ
in at most ``radius // segments`` bits of some segment.  For each segment a fingerprint goes to the
table under every key of a small Hamming ball around its segment.  Table and query side share the
ball: each enumerates half of its radius, so that two fingerprints meet under a key exactly if their
segments differ in at most the whole radius.  What meets is verified on the complete fingerprints.

Two segments of 32 bits (for the default 64-bit fingerprint and radius 4) make 66 keys a fingerprint;
among n unrelated fingerprints a key of 32 bits holds about 33 n / 2**32 of them, so tables
stay sparse for billions of documents.

For near-duplicates at a Jaccard similarity (``deduplicate``) the width of fingerprints and segments follows from the
number of documents (``plan``), and what the fingerprints link is verified on the shingle sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Scratch, map_batches, spare, utf8
from granary.llm.components import connected

SEED = 42
RADIUS = 4
SEGMENTS = 2
SHINGLE = 4
#: Fingerprints under one key that a task compares with each other; larger buckets are compared block by block.
BUCKET = 20_000
#: Buckets up to this size are compared pair by pair, all of a stretch at once; rows of a stretch.
FEW, STRETCH = 256, 1 << 15


def _votes(values: np.ndarray) -> np.ndarray:
    """For each of the 64 bits, from the highest, how many values have it."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(values), 1 << 14):
        counts += np.unpackbits(values[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return counts


def _majority(values: np.ndarray) -> int:
    """The bits that over half the values have."""
    return int.from_bytes(np.packbits(2 * _votes(values) > len(values)).tobytes(), "big")


def shingle_hashes(raw: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles in order, repeats included; of the whole sequence if it is shorter; none without words."""
    words = raw.lower().split()  # on ASCII blanks; lower-cases A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter([h(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64, n)


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 without words."""
    values = shingle_hashes(raw, shingle)
    return _majority(values) if len(values) else 0


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without its text, with ``fp`` (in place of a column of that name): the fingerprint as a signed 64-bit number."""
    rest = [c for c in docs.columns if c not in (text, "fp")]
    carried = docs.select(*[docs[c] for c in rest], utf8(docs[text]).alias(spare(docs)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[:-1]), "fp long"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array([_signed(fingerprint(raw, shingle)) for raw in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*rest, "fp"])

    return map_batches(carried, run, schema)


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of ``bits`` bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


@dataclass(frozen=True)
class Segments:
    """``count`` segments of ``width`` bits (64 at most) side by side in fingerprints of ``words64`` 64-bit words; they may cross from word to word."""

    count: int
    width: int
    words64: int = 1

    def _at(self, i: int) -> tuple[int, int, int]:
        """Word, shift, and bits that lie in the next word."""
        w, shift = divmod(i * self.width, 64)
        return w, shift, max(0, shift + self.width - 64)

    def values(self, fps: list[np.ndarray], i: int) -> np.ndarray:
        w, shift, over = self._at(i)
        out = fps[w] >> np.uint64(shift)
        if over:
            out = out | (fps[w + 1] << np.uint64(64 - shift))
        return out & np.uint64((1 << self.width) - 1)

    def column(self, names: list[str], i: int) -> Column:
        w, shift, over = self._at(i)
        out = F.shiftrightunsigned(names[w], shift)
        if over:
            out = out.bitwiseOR(F.shiftleft(names[w + 1], 64 - shift))
        return out.bitwiseAND(F.lit((1 << self.width) - 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; the last axis holds the words of a fingerprint."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _trees(ids: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect those of ``fps`` (distinct) that links connect: each new one is searched among those not yet reached."""
    edges: list[tuple[int, int]] = []
    while len(ids) > 1:
        root, reached = ids[0], [fps[0]]
        ids, fps = ids[1:], fps[1:]
        while reached and len(ids):
            near = _distances(fps, reached.pop()) <= radius
            if near.any():
                reached.extend(fps[near])
                edges.extend((root, x) for x in ids[near])
                ids, fps = ids[~near], fps[~near]
    return edges


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the smallest node of each component of the edges ``a, b`` to its other nodes."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[a], least[b])
        now = least.copy()
        for side in (a, b, least[a], least[b]):
            np.minimum.at(now, side, low)
        now = now[now]
        if (now == least).all():
            break
        least = now
    other = least != np.arange(len(nodes))
    return nodes[least[other]], nodes[other]


def names_of(words: list[np.ndarray]) -> np.ndarray:
    """64-bit names of fingerprints: the fingerprint itself, or a hash of its words."""
    if len(words) == 1:
        return words[0].view(np.int64)
    out = np.zeros(len(words[0]), np.uint64)
    for w in words:
        out = mixed(out + w)
    return out.view(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads what they differ in over all bits."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def links(distinct: DataFrame, radius: int = RADIUS, segments: Segments = Segments(SEGMENTS, 64 // SEGMENTS), within: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints within ``radius``: enough to connect whatever links connect.

    ``distinct`` has ``fp`` or ``fp0, fp1, ...``, and a fingerprint's name is that of ``names_of``.  ``within`` is the radius of a
    segment's ball; at ``radius // segments.count`` (the default) every link is found, a smaller one finds those of which
    some segment is that close.  A bucket of more than ``bucket`` fingerprints is dealt to blocks, and every pair of blocks
    is a group of its own, so that no task holds more than two blocks of a key.
    """
    whole = radius // segments.count if within is None else within
    if whole % 2:
        raise ValueError("the ball's radius is halved between table and query: it has to be even")
    words64 = segments.words64
    masks = np.array(ball(segments.width, whole // 2), np.uint64)
    names = ["fp"] if words64 == 1 else [f"fp{i}" for i in range(words64)]

    # Keys with many fingerprints, found from the counts of plain segment values.
    parts = [F.struct(F.lit(i).alias("s"), segments.column(names, i).alias("v")) for i in range(segments.count)]
    values = distinct.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    heavy = values.groupBy("s", "v").count().where(F.col("count") * len(masks) > bucket)  # a key of more than ``bucket`` has such a value near it

    def near_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        s, v, n = (batch.column(i).to_numpy() for i in range(3))
        keys = (v.astype(np.uint64)[:, None] ^ masks[None, :]) | (s.astype(np.uint64) << np.uint64(56))[:, None]
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(n, len(masks)))], names=["key", "n"])

    hot = map_batches(heavy, near_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > bucket)
    hot = hot.select("key", (F.ceil(F.col("n") / bucket) + 1).cast("int").alias("blocks"))

    def keys_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [batch.column(batch.num_columns - words64 + w).to_numpy().view(np.uint64) for w in range(words64)]
        keys = np.concatenate([(segments.values(fps, i)[:, None] ^ masks[None, :]) | np.uint64(i << 56) for i in range(segments.count)], axis=1)
        again = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *(c.take(again) for c in batch.columns)], names=["key", *names])

    table = map_batches(distinct.select(*names), keys_of, ", ".join(f"{c} long" for c in ["key", *names]))
    hot = Scratch(distinct.sparkSession, "simhash-hot").write(hot, "hot")
    group = ["key"]
    if not hot.isEmpty():
        group = ["key", "b1", "b2"]
        dealt = table.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = F.pmod(F.xxhash64(*names), F.col("blocks")).cast("int")
        table = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 or mine <> other").select(
            "key", F.least("mine", "other").cast("long").alias("b1"), F.greatest("mine", "other").cast("long").alias("b2"), *names
        )
    by = len(group)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of equal keys (and blocks) in sorted batches, a stretch of rows at a time; the last group of a stretch may go on in the next one."""
        held: list[np.ndarray] = []
        size = 0
        starts_of = lambda rows: np.flatnonzero((rows[:by, 1:] != rows[:by, :-1]).any(axis=0)) + 1
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            size += batch.num_rows
            if size < STRETCH or (held[0][:by, 0] == held[-1][:by, -1]).all():
                continue
            rows = np.concatenate(held, axis=1)
            starts = starts_of(rows)
            yield from emit(rows[by:, : starts[-1]], starts[:-1])
            held, size = [rows[:, starts[-1] :]], rows.shape[1] - starts[-1]
        if held:
            rows = np.concatenate(held, axis=1)
            yield from emit(rows[by:], starts_of(rows))

    def emit(rows: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = [np.ascontiguousarray(r).view(np.uint64) for r in rows]
        ids = names_of(words)
        starts = np.concatenate(([0], cuts))
        sizes = np.diff(np.concatenate((starts, [len(ids)])))
        few = sizes <= FEW
        left = np.repeat(sizes * few, sizes) - (np.arange(len(ids)) - np.repeat(starts, sizes))  # rows of a small group from here on
        edges = []
        for lag in range(1, sizes[few].max(initial=0)):
            far = np.bitwise_count(words[0][:-lag] ^ words[0][lag:]).astype(np.uint16)
            for w in words[1:]:
                far += np.bitwise_count(w[:-lag] ^ w[lag:])
            near = np.flatnonzero(far <= radius)
            near = near[left[near] > lag]
            edges.append(np.stack([ids[near], ids[near + lag]]))
        if not few.all():
            fps = np.stack(words, axis=1)
            for at, n in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
                if found := _trees(ids[at : at + n], fps[at : at + n], radius):
                    edges.append(np.array(found, np.int64).T)
        if edges and (out := np.concatenate(edges, axis=1)).shape[1]:
            a, b = _stars(out[0], out[1])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return table.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """``key, fp, component_id`` for each row: the smallest key reachable over links of at most ``radius`` bits.

    Texts without words, null ones included, have fingerprint zero and are linked like any other;
    null keys are rows, but no component's id while another row has a key (null if none has);
    repeated rows get a row each; an empty table gives an empty result; extra columns play no part.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs.select(docs[key].alias("key"), docs[text].alias("text")), shingle=shingle), "rows")
    distinct = scratch.write(rows.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    edges = links(distinct, radius, Segments(segments, 64 // segments), bucket=bucket)
    roots = connected(edges, scratch)
    labelled = scratch.write(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "labelled")
    ids = scratch.write(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    classes = scratch.write(labelled.join(ids, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select(F.col("key").alias(key), "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 lowercase hex digits) and ``component_id`` of each row."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near-duplicates at a similarity

#: Shingles and the Jaccard similarity from which documents are linked.
WORDS, LEAST = 5, 0.8
#: Share of the pairs at just that similarity that segments may miss, radius of a segment's ball, and the bits by which segments are shorter than the logarithm of the number of documents.
MISSED, WITHIN, CROWDING = 0.004, 2, 4
#: Standard deviations by which the radius exceeds the mean distance of pairs at just that similarity.
DEVIATIONS = 3.0
#: Shingles and sets of a block; a task compares two blocks at a time.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 20, 1024
#: Sets up to which a shingle counts as one that few share.
HOLDERS = 16


@dataclass(frozen=True)
class Plan:
    segments: Segments
    radius: int
    meet: float  # probability that some segment of a pair at the least similarity lies within the ball


def plan(documents: int, least: float = LEAST, missed: float = MISSED) -> Plan:
    """Fingerprints for so many documents.

    Sets of Jaccard similarity s have an angle whose cosine is 2 s / (1 + s), so each bit differs with probability p = angle / pi.
    Segments are CROWDING bits shorter than the logarithm of the number of documents, which keeps buckets small
    at any number; of segments there are as many as it takes for all but ``missed`` of the pairs at ``least`` to meet.
    The radius is the mean distance of such pairs plus DEVIATIONS standard deviations.
    """
    width = min(48, max(12, math.ceil(math.log2(max(2, documents))) - CROWDING))
    p = math.acos(2 * least / (1 + least)) / math.pi
    close = sum(math.comb(width, i) * p**i * (1 - p) ** (width - i) for i in range(WITHIN + 1))
    count = math.ceil(math.log(missed) / math.log(1 - close))
    words64 = max(2, -(-count * width // 64))
    bits = 64 * words64
    return Plan(Segments(count, width, words64), math.floor(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p))), 1 - (1 - close) ** count)


def shingle_set(raw: bytes, shingle: int = WORDS) -> np.ndarray:
    """Hashes of the distinct word shingles, sorted."""
    return np.unique(shingle_hashes(raw, shingle))


def set_name(values: np.ndarray) -> int:
    """64-bit hash of a shingle set: equal sets are one document from here on."""
    return _signed(xxhash.xxh64_intdigest(values.tobytes(), SEED))


def set_fingerprint(values: np.ndarray, words64: int) -> list[int]:
    """SimHash over a shingle set; further words of 64 bits come from the hashes mixed again."""
    out = []
    for _ in range(words64):
        out.append(_signed(_majority(values)) if len(values) else 0)
        values = mixed(values)
    return out


def sketches(tagged: DataFrame, words64: int, shingle: int = WORDS) -> DataFrame:
    """``key, th, id, n, name, fp0, fp1, ...`` of ``key, th, text``: the shingle set's hash, its size, its fingerprint and that one's name."""
    names = [f"fp{i}" for i in range(words64)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(raw, shingle) for raw in batch.column(2).to_pylist()]
        fps = np.array([set_fingerprint(s, words64) for s in sets], np.int64).reshape(-1, words64).T
        named = names_of([np.ascontiguousarray(w).view(np.uint64) for w in fps])
        made = [pa.array([set_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(named), *map(pa.array, fps)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["key", "th", "id", "n", "name", *names])

    kind = tagged.schema["key"].dataType.simpleString()
    return map_batches(tagged.select("key", "th", utf8("text").alias("raw")), run, ", ".join([f"key {kind}", "th long", "id long", "n long", "name long", *(f"{c} long" for c in names)]))


def similar_forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges (places in ``sets``) that connect what pairs with a Jaccard similarity of ``least`` connect.

    Sizes of intersections: shingles that few sets share are counted pair by pair of these sets, those of many in products of an
    incidence matrix with its transpose, a stretch of shingles at a time.  Shingles of one set only add nothing.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    holders = np.bincount(column)
    both = np.zeros((n, n))
    few = np.flatnonzero((holders[column] > 1) & (holders[column] <= HOLDERS))
    few = few[np.argsort(column[few], kind="stable")]
    for lag in range(1, min(HOLDERS, n)):
        a, b = few[:-lag], few[lag:]
        same = column[a] == column[b]
        if not same.any():
            break
        pair = np.bincount(owner[a[same]] * n + owner[b[same]], minlength=n * n).reshape(n, n)  # owners rise within a shingle
        both += pair
    both = (both + both.T).astype(np.float32)
    many = holders > HOLDERS
    kept = many[column]
    owner, column = owner[kept], (np.cumsum(many) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(1, min(int(many.sum()), (1 << 22) // n))
    for first in range(0, int(many.sum()), width):
        a, b = np.searchsorted(column, (first, first + width))
        part = np.zeros((n, width), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        both += part @ part.T
    np.fill_diagonal(both, sizes)
    near = both / (sizes[:, None] + sizes[None, :] - both.astype(np.float64)) >= least
    edges: list[tuple[int, int]] = []
    left = np.ones(n, bool)
    for root in np.flatnonzero(near.sum(axis=1) > 1).tolist():
        if not left[root]:
            continue
        left[root], front = False, np.array([root])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & left)
            left[front] = False
            edges.extend((root, x) for x in front.tolist())
    return edges


def verified(texts: DataFrame, least: float = LEAST, shingle: int = WORDS) -> DataFrame:
    """Edges ``a, b`` that connect what similar pairs within groups connect, from ``id, root, blocks, mine, raw``.

    The rows of a group ``root`` lie in ``blocks`` blocks, each in ``mine``.  Every pair of blocks is compared on its
    own, a single block with itself; a row that comes twice counts once.
    """

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams = pa.array([shingle_set(raw, shingle).tobytes() for raw in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], grams], names=["id", "root", "blocks", "mine", "grams"])

    rows = map_batches(texts.select("id", "root", "blocks", "mine", "raw"), sets, "id long, root long, blocks int, mine int, grams binary")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 or mine <> other")
    table = dealt.select("root", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), "id", "grams")

    def solve(held: dict[int, bytes]) -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        edges = similar_forest([np.frombuffer(g, np.uint64) for g in held.values()], least)
        if not edges:
            return None
        ids = np.fromiter(held, np.int64, len(held))
        a, b = (ids[list(side)] for side in zip(*edges, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for batch in batches:
            for root, b1, b2, i, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, b1, b2) != last:
                    if (out := solve(held)) is not None:
                        yield out
                    last, held = (root, b1, b2), {}
                held[i] = grams
        if (out := solve(held)) is not None:
            yield out

    return table.repartition("root", "b1", "b2").sortWithinPartitions("root", "b1", "b2").mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, groups: DataFrame, rows: DataFrame, scratch: Scratch, text: str, key: str) -> DataFrame:
    """The rows of ``docs`` that are ``first`` (``key, th``) of their group; one of those equal in key and text, which ``rows`` (``key, th``) tells."""
    stay = scratch.write(groups.select(F.col("first.key").alias("_key"), F.col("first.th").alias("_th")).distinct(), "stay")
    repeats = scratch.write(rows.groupBy("key", "th").count().where("count > 1").select(F.col("key").alias("_key"), F.col("th").alias("_th")), "repeats")
    kept = docs.join(stay, docs[key].eqNullSafe(stay["_key"]) & (F.xxhash64(docs[text], docs[text].isNull()) == stay["_th"]), "left_semi")
    if repeats.isEmpty():
        return kept
    again = kept[key].eqNullSafe(repeats["_key"]) & (F.xxhash64(kept[text], kept[text].isNull()) == repeats["_th"])
    return kept.join(repeats, again, "left_anti").unionByName(kept.join(repeats, again, "left_semi").dropDuplicates([key, text]))


def deduplicate(docs: DataFrame, least: float = LEAST, shingle: int = WORDS, text: str = "text", key: str = "doc_id", block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row of each group of near-duplicates, with all columns: the one of the smallest key, then the smallest hash of its text.

    Documents are linked whose sets of ``shingle``-word shingles have a Jaccard similarity of ``least`` or more.  Multi-index
    hashing of wide fingerprints (``plan``) finds the candidates; the groups that they connect are verified set by set, so nothing less
    similar is linked.  A link at just ``least`` is missed with a probability of about half a percent, above it with less.
    Of rows equal in key and text one stays.  Null keys come after all others; null and empty texts are one group; an empty
    table gives an empty result; extra columns are kept.
    """
    scratch = Scratch(docs.sparkSession, "simhash-dedup")
    how = plan(docs.count(), least)
    names = [f"fp{i}" for i in range(how.segments.words64)]
    tagged = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.xxhash64(docs[text], docs[text].isNull()).alias("th"))
    rows = scratch.write(sketches(tagged, how.segments.words64, shingle), "rows")
    distinct = rows.groupBy("id").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "th")).alias("first"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in ["name", *names]))
    distinct = scratch.write(distinct, "distinct")

    points = scratch.write(distinct.where("n > 0").groupBy(*names).agg(F.first("name").alias("name")), "points")
    close = scratch.write(connected(links(points, how.radius, how.segments, WITHIN), scratch), "close")
    members = distinct.where("n > 0").join(close, F.col("name") == F.col("node"), "left").select("id", "n", "first", F.coalesce("root", "name").alias("root"))
    members = scratch.write(members, "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.ceil(F.greatest(F.count("*") / block_sets, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("m > 1")
    wanted = members.join(sizes, "root").select("id", "root", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("mine"), F.col("first.key").alias("_key"), F.col("first.th").alias("_th"))
    # The texts of group members come again from the input; of equal rows one counts.
    wanted = scratch.write(wanted, "wanted")
    found = tagged.join(wanted, tagged["key"].eqNullSafe(wanted["_key"]) & (tagged["th"] == wanted["_th"])).select("id", "root", "blocks", "mine", utf8("text").alias("raw"))
    roots = connected(verified(found, least, shingle), scratch)
    groups = distinct.join(roots, distinct["id"] == roots["node"], "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first"))
    return one_of_each(docs, groups, rows, scratch, text, key)
