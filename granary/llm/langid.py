"""Language identification: hashed subword embeddings, averaged over the whole text, under a linear softmax.

Embeddings and softmax are trained together by stochastic gradient descent in numpy, on a bounded
sample of labelled texts.  Probabilities are calibrated by a temperature, and the probability below
which an answer is rejected is set so that a given share of right answers is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import fold, map_batches, spare, utf8
from granary.llm.subword import buckets, softmax

BITS = 13
WIDTH = 16
#: Labelled texts that a model is fitted on, over all languages, and those of each language where there are many.
SAMPLE, EACH = 2400, 12
#: Share of right answers that may be rejected.
LOST = 0.01


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    least: float  # probability below which an answer is rejected

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        mean = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return softmax((mean @ self.table + self.bias) / self.temperature)


def counts_of(raw: bytes) -> np.ndarray:
    return np.bincount(np.concatenate(buckets(raw, BITS)), minlength=1 << BITS)


def train(counts: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 40, rate: float = 0.5, seed: int = 1) -> LanguageModel:
    """Fits on four fifths of the rows, calibrates on the fifth."""
    rng = np.random.default_rng(seed)
    x = counts.astype(np.float32)
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    order = rng.permutation(len(x))
    fit, held = order[len(x) // 5 :], order[: len(x) // 5]
    n = len(languages)
    scale = 32.0  # averages of many small vectors are small; a fixed factor keeps the steps of both layers alike
    embed = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (WIDTH, n)).astype(np.float32), np.zeros(n, np.float32)
    target = np.eye(n, dtype=np.float32)[labels]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        fit = rng.permutation(fit)
        for k in range(0, len(fit), 32):
            rows = fit[k : k + 32]
            hidden = scale * (x[rows] @ embed)
            error = (softmax(hidden @ weights + bias) - target[rows]) / len(rows)
            d_hidden = error @ weights.T
            weights -= step * (hidden.T @ error)
            bias -= step * error.sum(axis=0)
            embed -= step * scale * (x[rows].T @ d_hidden)
    table = (scale * embed @ weights).astype(np.float64)
    model = LanguageModel(languages, table, bias.astype(np.float64), 1.0, 0.0)
    if len(held):
        logits = x[held] @ table + model.bias
        losses = {t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), labels[held]], 1e-12)).mean() for t in np.geomspace(0.25, 8, 21)}
        model.temperature = float(min(losses, key=losses.get))
        p = softmax(logits / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == labels[held]]
        model.least = float(np.quantile(right, LOST)) if len(right) else 0.0
    return model


def fit(labelled: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel | None:
    """A model from rows with a text and a label; None without any.

    Every language with a labelled text is learnt.  The sample is bounded for each: its part of ``sample`` rows, or
    EACH where there are more than ``sample / EACH`` languages; those of the smallest hashes of ``key`` (if
    there is one), text and language; whole texts, and the same ones at every run.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    seen = rows.groupBy(lang).count().collect()
    if not seen:
        return None
    languages = sorted(r[lang] for r in seen)
    each = max(EACH, sample // len(languages))
    # Twice as many as are taken, and some: enough of each language, and few to sort.
    shares = labelled.sparkSession.createDataFrame([(r[lang], min(1.0, (2 * each + 20) / r["count"])) for r in seen], "_lang string, _share double")
    hashed = F.xxhash64(*[c for c in (key,) if c in rows.columns], text, lang)
    likely = rows.withColumn("_hash", hashed).join(F.broadcast(shares), rows[lang] == shares["_lang"]).where(F.pmod("_hash", F.lit(1 << 30)) / float(1 << 30) < F.col("_share"))
    order = Window.partitionBy(lang).orderBy(F.pmod("_hash", F.lit(1 << 30)), "_hash")
    picked = likely.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= each)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [_shares(counts_of(raw)).tobytes() for raw in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.binary())], names=["lang", "counts"])

    got = map_batches(picked.select(F.col(lang).alias("lang"), utf8(text).alias("raw")), features, "lang string, counts binary").toArrow()
    got = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    if not got:
        return None
    number = {name: i for i, name in enumerate(languages)}
    shares = np.stack([np.frombuffer(x, np.float16) for _, x in got])
    return train(shares, np.array([number[name] for name, _ in got]), languages)


def _shares(counts: np.ndarray) -> np.ndarray:
    """Shares of the buckets in half precision, scaled so that small ones keep their digits: two bytes a bucket travel to the driver."""
    return (1024 * counts / max(1, counts.sum())).astype(np.float16)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred, score, rejected`` (in place of columns of these names).

    A null text and a text without a letter is ``und`` with score 0, rejected; so is every text if there
    is no model.  The answer to a text is the likeliest language and its calibrated probability;
    ``rejected`` marks those below the calibrated bound.
    """
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score", "rejected")]
    carried = docs.select(*[docs[c] for c in rest], F.coalesce(docs[text].rlike(r"\p{L}"), F.lit(False)).alias(spare(docs, "_letter")), utf8(docs[text]).alias(spare(docs)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[:-2]), "lang_pred string, score double, rejected boolean"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, rejected = [], [], []
        letters = batch.column(batch.num_columns - 2).to_pylist()
        for raw, letter in zip(batch.column(batch.num_columns - 1).to_pylist(), letters, strict=True):
            if not letter or model is None:
                name, p = "und", 0.0
            else:
                probabilities = model.probabilities(counts_of(raw)[None, :])[0]
                best = int(probabilities.argmax())
                name, p = model.languages[best], float(probabilities[best])
            names.append(name)
            scores.append(p)
            rejected.append(name == "und" or p < model.least)
        return pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(names), pa.array(scores, pa.float64()), pa.array(rejected)], names=[*rest, "lang_pred", "score", "rejected"])

    return map_batches(carried, run, schema)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for each row, learnt from the rows that aren't held out.

    Rows with a null id are neither held out nor learnt from.  Repeated rows get a row each; an empty
    table gives an empty result.
    """
    rows = docs.select("doc_id", "text", "lang")
    part = fold("doc_id", 5)
    model = fit(rows.where(part != 0))
    return predict(rows.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "text"), model)
