"""Toxicity: subword-bag embeddings, averaged, under a linear softmax; all trained together in numpy.

A bag holds the byte n-grams of a word within its fences; their embeddings are averaged and go through the softmax.  A toxic
text is mostly harmless words, so a text scores as its most toxic word does.  Training begins with the whole text as
one bag, which finds the n-grams that matter; then a text's label is that of its worst word (multiple-instance learning), and both
layers learn from that word.  Half of these bags lack the n-grams over a random place, as those of a misspelt word do.
Words that were never seen, such as misspellings, share n-gram vectors with those that were.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import fold, labelled, map_batches, spare, utf8
from granary.llm.subword import by_order, softmax, word_grams

BITS = 17
WIDTH = 8
#: N-grams over which a shorter word's are averaged too, as if the rest were silent: a bag of one n-gram is no strong evidence.
BAG = 10
#: Labelled texts of each label that a model is fitted on, and the bytes of the longest one taken for that.
SAMPLE, SAMPLE_BYTES = 3000, 50_000
#: Passes over the sample, and steps at least (a small sample is passed more often); the share of them with whole texts as bags, and those bags' scale.
EPOCHS, STEPS, WHOLE, SCALE = 12, 40_000, 0.25, 64.0
#: Share of the worst words in training that are masked at a place, and words whose n-grams are made at a time.
MASKED, STRETCH = 0.5, 10_000


@dataclass
class ToxicityModel:
    table: np.ndarray  # toxic minus harmless logit that a bucket adds to a bag's mean
    bias: float
    slope: float = 1.0  # calibration of the worst word's logit
    shift: float = 0.0

    def worst(self, raw: bytes) -> float:
        """The mean over the worst word's bag; 0 for a text without words."""
        parts = by_order(raw, BITS)
        n = 1 + max((int(word[-1]) for _, word, _, _ in parts if len(word)), default=-1)
        sums, counts = np.zeros(n), np.zeros(n, np.int64)
        for grams, word, _, _ in parts:
            sums += np.bincount(word, weights=self.table[grams], minlength=n)
            counts += np.bincount(word, minlength=n)
        held = counts > 0
        return (float((sums[held] / np.maximum(counts[held], BAG)).max()) if held.any() else 0.0) + self.bias

    def score(self, raw: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.worst(raw) + self.shift, -40, 40))))


def features(raw: bytes) -> bytes:
    """The distinct words of a text, lower-cased."""
    return b" ".join(sorted(set(raw.lower().split())))


class Words:
    """The words of all texts and their n-grams, each word once; texts are numbers of words."""

    def __init__(self, texts: list[bytes]):
        known: dict[bytes, int] = {}
        self.texts = [np.array([known.setdefault(w, len(known)) for w in features(t).split()], np.int32) for t in texts]
        parts, names = [], list(known)
        for at in range(0, len(names), STRETCH):
            grams, word, place, size = word_grams(b" ".join(names[at : at + STRETCH]), BITS)
            count = np.bincount(word)
            begin = np.repeat(place[np.cumsum(count) - count], count)  # places count from a word's first n-gram on
            parts.append((grams.astype(np.int32), (place - begin).astype(np.int32), size.astype(np.int8), count.astype(np.int32)))
        self.grams, self.place, self.size, self.count = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32),) * 4
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def bag(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of some words in a row, and where each word's begin."""
        count = self.count[words]
        begin = np.cumsum(count) - count
        return self.grams[np.repeat(self.first[words] - begin, count) + np.arange(count.sum())], begin

    def worst(self, words: np.ndarray, table: np.ndarray) -> int:
        """The word of the greatest mean."""
        grams, begin = self.bag(words)
        return int(words[(np.add.reduceat(table[grams], begin) / np.maximum(self.count[words], BAG)).argmax()])

    def masked(self, word: int, rng: np.random.Generator) -> np.ndarray:
        """A word's n-grams without those over a random letter."""
        mine = slice(self.first[word], self.first[word + 1])
        begin, end = self.place[mine], self.place[mine] + self.size[mine]
        hole = rng.integers(1, max(2, end.max() - 1))
        return self.grams[mine][(begin > hole) | (end <= hole)]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3, seed: int = 1) -> ToxicityModel:
    """Fits on four fifths of the texts, calibrates on the fifth."""
    rng = np.random.default_rng(seed)
    words = Words(texts)
    order = rng.permutation(len(texts))
    fit, held = order[len(texts) // 5 :], order[: len(texts) // 5]
    embed = rng.normal(0, 0.02, (1 << BITS, WIDTH)).astype(np.float32)
    weights, bias = rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    past = np.full(1 << BITS, 1e-2, np.float32)  # squared steps of each bucket so far: its next ones are scaled by them
    prior = np.bincount(labels[fit], minlength=2).clip(1) / max(1, len(fit))
    logit = lambda rows: embed[rows] @ (weights[:, 1] - weights[:, 0])
    table = logit(slice(None))
    epochs = max(epochs, -(-STEPS // max(1, len(fit))))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            mine = words.texts[i]
            if not len(mine):
                continue
            if epoch < WHOLE * epochs:
                scale, bag = SCALE, words.bag(mine)[0]
                full = len(bag)
            else:
                at = words.worst(mine, table)
                scale, full = 1.0, int(words.count[at])
                bag = words.masked(at, rng) if rng.random() < MASKED else words.grams[words.first[at] : words.first[at + 1]]
            rows, times = np.unique(bag, return_counts=True)
            share = (scale * times / max(full, BAG)).astype(np.float32)
            hidden = share @ embed[rows]
            error = softmax(hidden @ weights + bias)
            error[labels[i]] -= 1
            error = error * np.float32(0.5 / prior[labels[i]])
            d_hidden = weights @ error
            weights -= 0.02 * step * np.outer(hidden, error)
            bias -= 0.02 * step * error
            past[rows] += share * share * float(d_hidden @ d_hidden)
            embed[rows] -= (step * share / np.sqrt(past[rows]))[:, None] * d_hidden[None, :]
            table[rows] = logit(rows)
        table = logit(slice(None))
    model = ToxicityModel(table.astype(np.float32), float(bias[1] - bias[0]))
    _calibrate(model, [texts[i] for i in held], labels[held])
    return model


def _calibrate(model: ToxicityModel, texts: list[bytes], labels: np.ndarray) -> None:
    """Logistic regression of the label on the worst word's logit, both labels counting alike."""
    if len(set(labels.tolist())) < 2:
        return
    x = np.array([model.worst(t) for t in texts])
    centre, spread = x.mean(), max(x.std(), 1e-6)
    z, w, b = (x - centre) / spread, 1.0, 0.0
    each = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(1000):
        error = each * (1 / (1 + np.exp(-(w * z + b))) - labels)
        w, b = w - 0.5 * ((error * z).mean() + 1e-4 * w), b - 0.5 * error.mean()
    model.slope, model.shift = float(w / spread), float(b - w * centre / spread)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = SAMPLE_BYTES, text: str = "text", key: str = "doc_id", label: str = "toxic") -> ToxicityModel | None:
    """A model from the rows that ``labels`` marks 0 or 1; None without both labels.

    Bounded: at most ``sample`` texts of each label, of at most ``longest`` bytes, taken whole; conflicting and repeated
    marks as in ``labelled``.  The distinct words of a text are what is learnt from.
    """
    got = labelled(docs, labels, label, sample, features, key, text, longest)
    return None if got is None else train(got[1], np.array(got[0], np.int64))


def predict(docs: DataFrame, model: ToxicityModel | None, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without its text, with ``score`` and ``predicted`` (in place of columns of these names).

    Null and empty texts are scored as a text of nothing; without a model all score 0.
    """
    rest = [c for c in docs.columns if c not in (text, "score", "predicted")]
    carried = docs.select(*[docs[c] for c in rest], utf8(docs[text]).alias(spare(docs)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[:-1]), "score double, predicted int"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.array([model.score(raw) if model else 0.0 for raw in batch.column(batch.num_columns - 1).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=[*rest, "score", "predicted"])

    return map_batches(carried, run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row, learnt from labels of rows that aren't held out.

    Rows with a null id are neither held out nor learnt from; repeated rows get a row each; empty tables
    give an empty result (documents) or score 0 (labels).
    """
    model = fit(docs, labels.where(fold("doc_id", 3) != 1))
    return predict(docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text"), model)
