"""The trained operators against plain loops, on words they never saw, and on tables with odd labels and names."""

import math
import os
import random
import zlib

import numpy as np
import pytest

from granary.llm import langid, quality, toxicity
from granary.llm.subword import buckets, word_grams

BAD = ["wicked", "fiendish", "scoundrel", "despicable", "villain"]


def texts_of(seed, n, altered=False):
    """Texts of made-up words; every third holds one or two bad words, altered by one letter on demand."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(k % 3 + 1)) for k in range(300)]
    out = []
    for i in range(n):
        words = [rng.choice(stems) for _ in range(rng.randint(15, 120))]
        if i % 3 == 0:
            for _ in range(rng.randint(1, 2) + len(words) // 60):
                bad = list(rng.choice(BAD))
                if altered:
                    bad[rng.randrange(1, len(bad))] = rng.choice("kqxz")
                words.insert(rng.randrange(len(words)), "".join(bad))
        out.append((" ".join(words), int(i % 3 == 0)))
    return out


@pytest.fixture(scope="module")
def toxic_model():
    seen = texts_of(1, 900)
    return toxicity.train([t.encode() for t, _ in seen], np.array([y for _, y in seen]))


def test_toxicity_of_words_never_seen(toxic_model):
    """Recall on texts whose bad words are all altered by one letter, at no false alarm to speak of."""
    held = texts_of(2, 600)
    scores = [toxic_model.score(t.encode()) for t, _ in held]
    assert np.mean([(s >= 0.7) == bool(y) for s, (_, y) in zip(scores, held, strict=True)]) > 0.99
    altered = texts_of(3, 600, altered=True)
    got = [(toxic_model.score(t.encode()) >= 0.7, y) for t, y in altered]
    assert np.mean([p for p, y in got if y]) >= 0.6 and np.mean([p for p, y in got if not y]) <= 0.02
    assert toxic_model.score("a wickedly quiet fiend".encode()) >= 0.7


def plain_grams(word):
    fenced = b" " + word + b" "
    return [fenced[i : i + n] for n in (3, 4, 5) for i in range(len(fenced) - n + 1)]


def test_toxicity_by_a_plain_loop(toxic_model):
    for text in ["", " \n ", "Wicked  a\tfiendish day", "é", "x" * 300, texts_of(4, 1)[0][0]]:
        means = []
        for word in text.encode().lower().split():
            total = 0.0
            grams = plain_grams(word)
            for g in grams:  # an n-gram is a stretch of its own length within these blanks
                total += float(toxic_model.table[int(word_grams_of(g))])
            means.append(total / max(len(grams), toxicity.BAG))
        logit = (max(means) if means else 0.0) + toxic_model.bias
        want = 1 / (1 + math.exp(-max(-40.0, min(40.0, toxic_model.slope * logit + toxic_model.shift))))
        assert abs(toxic_model.score(text.encode()) - want) < 1e-9


def word_grams_of(gram):
    """The bucket of one n-gram, by plain numbers."""
    h = gram[0]
    for n, c in enumerate(gram[1:], 2):
        h = (h * 0x01000193 + c + n) % 2**32
    return ((h ^ h >> 15) * 0x2C1B3C6D) % 2**32 >> 32 - toxicity.BITS


def test_word_grams_by_a_plain_loop():
    raw = "Ab  cdé\n x".encode()
    grams, word, place, size = word_grams(raw, toxicity.BITS)
    data = b" " + raw.lower().replace(b"\n", b" ") + b" "
    want = sorted((i, w) for i, w in enumerate(raw.lower().split()) for _ in plain_grams(w))
    assert sorted(word.tolist()) == [i for i, _ in want]
    for g, p, n in zip(grams.tolist(), place.tolist(), size.tolist(), strict=True):
        part = data[p : p + n]
        assert b" " not in part[1:-1] and g == word_grams_of(part)


def test_language_by_a_plain_loop():
    rng = np.random.default_rng(0)
    model = langid.LanguageModel(["a", "b", "c"], rng.normal(size=(1 << langid.BITS, 3)), rng.normal(size=3), 0.7, 0.5)
    for text in ["hello there", "é", "a much longer text " * 30]:
        grams = [int(b) for part in buckets(text.encode(), langid.BITS) for b in part]
        logits = [sum(model.table[g, i] for g in grams) / max(1, len(grams)) + model.bias[i] for i in range(3)]
        e = [math.exp(x / 0.7) for x in logits]
        assert np.allclose(model.probabilities(langid.counts_of(text.encode())[None, :])[0], [x / sum(e) for x in e])


def test_rejection(spark):
    rng = random.Random(3)
    words = {"en": ["the", "and", "over"], "de": ["der", "und", "nicht"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i in range(200) for lang in [("en", "de")[i % 2]]]
    rows += [(1000, "the and over der und nicht " * 5, None), (1001, "zzz qqq", None)]
    out = {r.doc_id: r for r in langid.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    clear = [out[i] for i in range(200) if out[i].held_out]
    assert np.mean([r.rejected for r in clear]) <= 0.25 and all(r.score > 0.9 for r in clear if not r.rejected)
    assert out[1000].rejected and out[1000].lang_pred in ("en", "de")


def test_forest_by_a_plain_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, quality.FEATURES))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    forest = quality.train(x, y, np.ones(400))
    for row, score in zip(x[:50], forest.scores(x[:50]), strict=True):
        total = forest.base
        for feature, bound, leaf in zip(forest.feature, forest.bound, forest.leaf, strict=True):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if row[feature[node]] > bound[node] else 1)
            total += leaf[node - (2**quality.DEPTH - 1)]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9
    assert np.mean((forest.scores(x) > 0.5) == y) > 0.9


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_odd_labels_and_names(spark, operator):
    name = "toxic" if operator is toxicity else "quality"
    rows = [(i, t if y else t.upper() + " $$$", 5.0, 7, "x", "y") for i, (t, y) in enumerate(texts_of(6, 240))]
    docs = spark.createDataFrame(rows + rows[:3] + [(None, None, 0.0, 0, None, None), (900, "", 0.0, 0, None, None)], "doc_id long, text string, score double, predicted int, _text string, y string")
    marks = [(i, y) for i, (_, y) in enumerate(texts_of(6, 240))]
    odd = [*marks, *marks[:50], (0, 1 - marks[0][1]), (1, None), (2, 7), (None, 1), (5000, 0)]  # repeated, conflicting, null, unknown
    labels = spark.createDataFrame(odd, f"doc_id long, {name} int")
    same = operator.fit(docs, labels), operator.fit(docs.repartition(3), labels.repartition(2))
    out = operator.predict(docs, same[0])
    assert out.columns == ["doc_id", "_text", "y", "score", "predicted"] and out.count() == docs.count()
    assert sorted(map(str, out.collect())) == sorted(map(str, operator.predict(docs, same[1]).collect()))
    full = operator.report(docs, labels.limit(0)).collect()
    assert {r.score for r in full} == {0.0} and len(full) == docs.count() and operator.report(docs.limit(0), labels).count() == 0


FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_held_out_rows(spark):
    """Floors on the rows held out of sf0.01, which has some thirty toxic texts to learn from."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r for r in labels.collect()}
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    toxic = [(r.predicted, truth[r.doc_id].toxic) for r in toxicity.report(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([p for p, y in toxic if y]) >= 0.7 and np.mean([p for p, y in toxic if not y]) <= 0.1
    good = [r.predicted == truth[r.doc_id].quality for r in quality.report(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert np.mean(good) >= 0.9
    named = [r.lang_pred == langs[r.doc_id] for r in langid.report(docs).collect() if r.held_out and langs[r.doc_id] is not None and r.lang_pred != "und"]
    assert np.mean(named) >= 0.9 and all(zlib.crc32(str(i).encode()) is not None for i in list(langs)[:1])
