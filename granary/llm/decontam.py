"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is over words.  Each worker streams its documents through it and tracks the longest
suffix of what it has read that occurs in an item; where that length reaches the window, the window's
words are hit, and the state tells which items hold that window.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Scratch, map_batches, spare, utf8

WINDOW = 10
#: Item words from which one automaton is built (on the driver, some 700 bytes a word while it is built), and those of the automata that a
#: task holds in one pass over the documents (some 40 bytes a word, and the words).
BLOCK_WORDS, PASS_WORDS = 500_000, 4_000_000


def _table() -> bytes:
    out = bytearray(b" " * 256)
    for c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        out[c] = c
    for c in range(0x41, 0x5B):
        out[c] = c + 32
    return bytes(out)


#: Lower-cases A-Z and blanks every byte that is no part of a word: words are digits, a-z and all beyond ASCII.
NORMAL = _table()


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


class _Building:
    """Generalised suffix automaton under construction: ways on by word, suffix links, longest lengths."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for text in texts:
            last = 0
            for c in text:
                last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy


class Automaton:
    """Generalised suffix automaton over word numbers, with what a window or a whole short item needs at each state.

    Kept in arrays, some twenty bytes a state: most states have one way on; those with several have theirs in a dictionary.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        texts = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        built = _Building(texts)
        self.link, self.length = array("i", built.link), array("i", built.length)
        by_length = sorted(range(1, len(built.link)), key=built.length.__getitem__)
        # For states that hold a window: the last one up the links that still does.
        self.top = array("i", [0]) * len(built.link)
        for k in by_length:
            if built.length[k] >= window:
                up = built.link[k]
                self.top[k] = self.top[up] if built.length[up] >= window else k
        found: dict[int, list[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for i, text in enumerate(texts):
            state = 0
            for read, c in enumerate(text, 1):
                state = built.next[state][c]
                if read >= window:
                    held = found.setdefault(self.top[state], [])
                    if not held or held[-1] != i:
                        held.append(i)
            if 0 < len(text) < window:
                short.setdefault(state, []).append((len(text), i))
        self.items = {k: array("i", held) for k, held in found.items()}
        # Short items that end a state's strings: its own and those of its suffixes.
        self.short: dict[int, tuple[tuple[int, int], ...]] = {}
        for k in by_length:
            above = self.short.get(built.link[k], ())
            if k in short or above:
                self.short[k] = (*short[k], *above) if k in short else above
        self.shortest = min([window, *(len(t) for t in texts if t)])
        one = [next(iter(ways.items())) if len(ways) == 1 else (-1, 0) for ways in built.next]
        self.way, self.to = (array("i", side) for side in zip(*one, strict=True))
        self.more = {k: ways for k, ways in enumerate(built.next) if len(ways) > 1}

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (from, to) of words inside occurring windows, in order and disjoint, and the items that have them.

        A word that no item has takes the automaton back to its root, so only runs of item words of
        at least the shortest window are streamed through it.
        """
        get = self.vocabulary.get
        ids = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        gaps = np.flatnonzero(ids < 0)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(ids)]))
        long = ends - starts >= self.shortest
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        way, to, more, link, length, window, short = self.way, self.to, self.more, self.link, self.length, self.window, self.short
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            state = held = 0
            for at, c in enumerate(ids[start:end].tolist(), start + 1):
                while True:
                    if way[state] == c:
                        state, held = to[state], held + 1
                        break
                    ways = more.get(state)
                    if ways is not None and c in ways:
                        state, held = ways[c], held + 1
                        break
                    if not state:
                        break
                    state = link[state]
                    held = length[state]
                reach = 0
                if held >= window:
                    reach = window
                    found.update(self.items[self.top[state]])
                if short:
                    for size, item in short.get(state, ()):
                        if size <= held:
                            found.add(item)
                            reach = max(reach, size)
                if reach:
                    if spans and spans[-1][1] >= at - reach:
                        begin = min(spans[-1][0], at - reach)
                        spans.pop()
                        while spans and spans[-1][1] >= begin:
                            begin = min(begin, spans.pop()[0])
                        spans.append((begin, at))
                    else:
                        spans.append((at - reach, at))
        return spans, found


def passes_of(benchmark: DataFrame, text: str = "text", key: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS, pass_words: int = PASS_WORDS) -> Iterator[list[Automaton]]:
    """The automata of the test items, each of a bounded number of words, in lists for one pass over the documents.

    Items come to the driver one by one, and no more of them are held than one automaton is built from.  Items without words have
    no window and are left out; null keys are kept.
    """
    held: list[tuple[str | None, list[bytes]]] = []
    machines: list[Automaton] = []
    words_held = in_pass = 0
    for row in benchmark.select(benchmark[key].cast("string").alias("k"), utf8(benchmark[text]).alias("t")).toLocalIterator():
        words = words_of(bytes(row.t))
        if not words:
            continue
        if held and words_held + len(words) > block_words:
            machines.append(Automaton(held, window))
            held, words_held = [], 0
        if machines and in_pass + len(words) > pass_words:
            if held:
                machines.append(Automaton(held, window))
            yield machines
            held, words_held, machines, in_pass = [], 0, [], 0
        held.append((row.k, words))
        words_held += len(words)
        in_pass += len(words)
    if held:
        machines.append(Automaton(held, window))
    if machines:
        yield machines


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
SPANS_TYPE = "array<struct<begin:bigint,end:bigint>>"
FOUND = ("n_words", "n_hit", "items", "spans")


def find_matches(docs: DataFrame, machines: list[Automaton], text: str = "text", before: bool = False, keep_text: bool = False) -> DataFrame:
    """``docs`` without its text (unless it is kept), with ``n_words, n_hit, items, spans`` (spans of hit words, those of all automata united; in place of columns of these names).

    With ``before``, what these columns hold from an earlier pass is united with what this one finds.
    """
    rest = [c for c in docs.columns if c not in (text, *FOUND)]
    carried = docs.select(docs[text], *[docs[c] for c in rest], *([docs["items"], docs["spans"]] if before else []))
    kept = [text, *rest] if keep_text else rest
    types = {f.name: f.dataType.simpleString() for f in carried.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"n_words long, n_hit long, items array<string>, spans {SPANS_TYPE}"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_hit, names, spans = [], [], [], []
        texts, others = batch.column(0).to_pylist(), batch.columns[1 : 1 + len(rest)]
        known = zip(*(c.to_pylist() for c in batch.columns[-2:]), strict=True) if before else (((), ()) for _ in texts)
        for value, (items, old) in zip(texts, known, strict=True):
            words, named = words_of((value or "").encode()), set(items)
            hit = [(s["begin"], s["end"]) for s in old]
            for machine in machines if words else ():
                more, found = machine.match(words)
                hit += more
                named.update(machine.names[i] for i in found)
            hit = _united(hit)
            n_words.append(len(words))
            n_hit.append(sum(b - a for a, b in hit))
            names.append(sorted(named, key=lambda name: (name is None, name or "")))
            spans.append([{"begin": a, "end": b} for a, b in hit])
        made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, SPANS)]
        return pa.RecordBatch.from_arrays([*([batch.column(0)] if keep_text else []), *others, *made], names=[*kept, *FOUND])

    return map_batches(carried, run, schema)


def _all_matches(docs: DataFrame, passes: Iterator[list[Automaton]], text: str, keep_text: bool = False) -> DataFrame:
    """``find_matches`` over all passes; what one finds is written before the next, so that no task holds the automata of two."""
    scratch, k = Scratch(docs.sparkSession, "decontam"), 0
    machines, following = next(passes, []), next(passes, None)
    out = find_matches(docs, machines, text, False, keep_text or following is not None)
    while following is not None:
        machines, following = following, next(passes, None)
        out = find_matches(scratch.write(out, f"pass{k}"), machines, text, True, keep_text or following is not None)
        k += 1
    return out


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, max_words: int = 0, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """Removes the spans that occur in test items from texts whose overlap exceeds the limits.

    A text over a limit (more than ``max_words`` hit words and more than ``max_share`` of its words)
    loses its hit words with what stands between them; other texts, null and empty ones included, stay
    as they are, and so does every other column.  Spans of all items are found on the text as it came,
    united, held against the limits and cut once.  An empty benchmark changes nothing.  Rows keep their number.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name of a column that matching adds
    plain = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    found = _all_matches(plain, passes_of(benchmark, item_text, item_key, window, block_words, pass_words), names[text], True)
    at, schema = docs.columns.index(text), docs.schema
    slim = found.select(*names.values(), "n_words", "n_hit", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        n_words, n_hit, spans = (c.to_pylist() for c in batch.columns[-3:])
        for i, (words, hit) in enumerate(zip(n_words, n_hit, strict=True)):
            if hit > max_words and hit > max_share * words:
                texts[i] = _without(texts[i].encode(), [(s["begin"], s["end"]) for s in spans[i]]).decode()
        columns = list(batch.columns[:-3])
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_batches(slim, run, schema)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """In order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes of the words in ``spans``, from the first word's start to the last one's end."""
    blank = np.frombuffer(raw.translate(NORMAL), np.uint8) == 32
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : begins[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]])


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = WINDOW, block_words: int = BLOCK_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """For each row: ``key, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and empty texts have no words and are clean; null keys and repeated rows get a row each; an
    empty benchmark hits nothing.  Items with a null id are hit like any other: together they count as one
    item, which has no place in ``items_sha256``.  Extra columns play no part.
    """
    rows = docs.select(F.col(key).alias("key"), "text")
    found = _all_matches(rows, passes_of(benchmark, window=window, block_words=block_words, pass_words=pass_words), "text")
    return found.select(
        F.col("key").alias(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
