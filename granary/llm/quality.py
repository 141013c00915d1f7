"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees of fixed depth are kept as flat arrays (feature, bound and leaf value by node number), and a
batch of documents walks all trees at once in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import fold, labelled, map_batches, spare, utf8

#: Labelled rows of each label that a model is fitted on.
SAMPLE = 6000
BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.15


def _classes() -> tuple[np.ndarray, int]:
    """A class for each byte: those of a class are counted together."""
    groups = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b":;", b"'\"", b"-", b"_", b"|", b"#", b"$", b"%", b"&", b"*", b"@", b"/\\", b"()[]{}", b"<>", b"=+^~`"]
    table = np.full(256, len(groups), np.uint8)
    for i, group in enumerate(groups):
        table[list(group)] = i
    table[0x80:] = len(groups) + 1
    return table, len(groups) + 2


_CLASS, _N = _classes()
FEATURES = _N + 9


def statistics(raw: bytes) -> np.ndarray:
    out = np.zeros(FEATURES)
    if not raw:
        return out
    counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=_N)
    out[:_N] = counts / len(raw)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    out[_N:] = (
        np.log1p(len(raw)),
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        len(set(words)) / n,
        n / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        (raw.count(b". ") + raw.count(b".\n")) / n,
        lengths.max(),
    )
    return out


@dataclass
class Forest:
    feature: np.ndarray  # tree x inner node
    bound: np.ndarray  # tree x inner node: greater goes right
    leaf: np.ndarray  # tree x leaf
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.feature)), np.int64)
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.bound[trees, node])
        total = self.base + self.leaf[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, least: float = 8.0, shrink: float = 4.0) -> Forest:
    """Boosted trees on the logistic loss; splits are sought on histograms of gradients."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    n_features = x.shape[1]
    flat = binned + np.arange(n_features) * BINS
    rate = np.average(y, weights=weight).clip(1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    total = np.full(len(y), base)
    inner = 2**DEPTH - 1
    features, bounds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            slot = (node - first)[:, None] * (n_features * BINS) + flat
            size = width * n_features * BINS
            sums = [np.bincount(slot.ravel(), weights=np.repeat(v, n_features), minlength=size).reshape(width, n_features, BINS).cumsum(axis=2) for v in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + shrink) + (gt - gl) ** 2 / (ht - hl + shrink) - gt**2 / (ht + shrink)
            gain[(hl < least / 4) | (ht - hl < least / 4)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + k], bound[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > bound[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, weights=g, minlength=2**DEPTH) / (np.bincount(at, weights=h, minlength=2**DEPTH) + shrink)
        total = total + leaf[at]
        features.append(feature)
        bounds.append(bound)
        leaves.append(leaf)
    return Forest(np.stack(features), np.stack(bounds), np.stack(leaves), base)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id", label: str = "quality") -> Forest | None:
    """A forest from the rows that ``labels`` marks 0 or 1; None without both labels.

    Bounded: at most ``sample`` texts of each label, whole ones; conflicting and repeated marks as in ``labelled``.  Rows are
    weighted back to the labels' shares.
    """
    got = labelled(docs, labels, label, sample, lambda raw: statistics(raw).tobytes(), key, text)
    if got is None:
        return None
    y, counts = np.array(got[0], np.float64), got[2]
    x = np.stack([np.frombuffer(raw) for raw in got[1]])
    seen = np.bincount(y.astype(int), minlength=2)
    weight = np.where(y == 1, counts[1] / seen[1], counts[0] / seen[0])
    return train(x, y, weight / weight.mean())


def _score_batch(model: Forest | None, texts: list[bytes]) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    return model.scores(np.stack([statistics(raw) for raw in texts])) if texts else np.zeros(0)


def predict(docs: DataFrame, model: Forest | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` without its text, with ``score`` and ``predicted`` (in place of columns of these names).  Null texts score as empty ones; without a model all score 0."""
    rest = [c for c in docs.columns if c not in (text, "score", "predicted")]
    carried = docs.select(*[docs[c] for c in rest], utf8(docs[text]).alias(spare(docs)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[:-1]), "score double, predicted int"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = _score_batch(model, batch.column(batch.num_columns - 1).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=[*rest, "score", "predicted"])

    return map_batches(carried, run, schema)


def keep(docs: DataFrame, model: Forest | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't reject; all rows without a model."""
    if model is None:
        return docs
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = _score_batch(model, [(x or "").encode() for x in batch.column(at).to_pylist()])
        return batch.filter(pa.array(scores >= threshold))

    return map_batches(docs, run, docs.schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row, learnt from labels of rows that aren't held out.

    Rows with a null id are neither held out nor learnt from; repeated rows get a row each; empty tables
    give an empty result (documents) or score 0 (labels).
    """
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    return predict(docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text"), model)
