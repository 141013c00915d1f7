"""The corpus pipeline, stage by stage, on a small folder of tables."""

import random
import re
from collections import Counter

import pytest

from granary.llm import decontam

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    words = [f"word{i}" for i in range(500)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    rows, labels = [], []
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(40, 90)))
        junk = i % 5 == 0
        if junk:
            text = " ".join(w.upper() + "$$$" for w in text.split())
        elif i % 7 == 0 and i > 7:
            text = rows[1][1]  # copies
        elif i % 11 == 0:
            text += " " + passage
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not junk), 0))
    rows += [(None, None, None, None, None), (400, "", "en", None, 0)]
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root), passage


def test_stages(spark, folder, tmp_path):
    root, passage = folder
    docs, seen = spark.read.parquet(f"{root}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, root)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    clean = [r for r in seen["quality"] if r.doc_id is not None and r.doc_id < 300]
    assert all(r.doc_id % 5 for r in clean) and len(clean) >= 235
    once = Counter(r.text or "" for r in seen["near_duplicates"])  # null and empty texts are one group
    assert max(once.values()) == 1 and set(once) == {r.text or "" for r in seen["quality"]}
    for r in seen["decontamination"]:
        assert passage not in (r.text or "") and r.n_chars == (None if r.text is None else len(r.text))
    assert len(seen["decontamination"]) == len(seen["near_duplicates"])
    copies = Counter(r.doc_id for r in seen["mixing"])
    assert max(copies.values()) <= 2
    words = lambda rows: sum(len(re.findall(r"\S+", r.text or "")) for r in rows)
    assert abs(words(seen["mixing"]) - 1.5 * words(seen["decontamination"])) < 4 * 100
    assert {r.shard for r in seen["sharding"]} <= set(range(40)) and len(seen["sharding"]) == len(seen["mixing"])
    by_text = {}
    for r in seen["sharding"]:
        assert by_text.setdefault(r.text or "", r.shard) == r.shard


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert "shard" in out.columns and out.count() > 200
    assert corpus_pipeline.ORACLE_SQL is None


def test_cut_text_keeps_the_rest():
    text = "Keep this. ONE two, three! And that."
    words = decontam.words_of(text.encode())
    assert words[2:5] == [b"one", b"two", b"three"]
    assert decontam._without(text.encode(), [(2, 5)]) == b"Keep this. ! And that."


def run_stages(spark, root, tmp_path):
    docs, out = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, root).write.parquet(str(tmp_path / name))
        docs = out[name] = spark.read.parquet(str(tmp_path / name))
    return out


def test_empty_tables(spark, tmp_path):
    root = tmp_path / "empty"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    out = run_stages(spark, str(root), tmp_path)
    assert all(df.count() == 0 for df in out.values()) and out["sharding"].columns[-1] == "shard"


def similarity(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Long texts, near copies, ties, repeated rows, nulls everywhere, and extra columns whose names the stages use themselves."""
    rng = random.Random(33)
    words = [f"word{i}" for i in range(2000)]
    rows, groups = [], {}
    for i in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(60, 120)))
        rows.append((i, text))
        if i % 6 == 0:  # near copies, above and below the similarity
            held = text.split()
            for k in (1, 2):
                mine = list(held)
                for at in rng.sample(range(len(held)), k if i % 12 else 12):
                    mine[at] = f"new{i}x{k}x{at}"
                rows.append((1000 + 10 * i + k, " ".join(mine)))
                groups[1000 + 10 * i + k] = i
    rows += [(500, " ".join(rng.choice(words) for _ in range(60_000))), (501, None), (502, ""), (None, None), (None, rows[3][1]), rows[5], rows[5], (7, "other text of the same id " * 3)]
    extra = "key string, th long, shard string, _key int, _rows int, place int, c0 string, size int, spans int, items string, score int, predicted int, row int, id int, n int, root int"
    names = [x.split()[0] for x in extra.split(", ")]
    docs = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", None if t is None else len(t), *([None] * len(names))) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    root = tmp_path / "odd"
    docs.repartition(3).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(None, 0, None), (500, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, ""), (3, " ".join(words[:12]))], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    out = run_stages(spark, str(root), tmp_path)
    assert all(df.columns == docs.columns for name, df in out.items() if name != "sharding") and set(out["sharding"].columns) == set(docs.columns)
    assert out["quality"].count() == len(rows)  # only one label: nothing is rejected
    kept = Counter(r.doc_id for r in out["near_duplicates"].collect())
    text_of = {}
    for i, t in rows:
        text_of.setdefault(i, t)
    for copy, first in groups.items():
        near = [similarity(text_of[copy], text_of[other]) >= 0.8 for other in (first, *(c for c, f in groups.items() if f == first and c < copy))]
        assert (copy in kept) == (not any(near)), (copy, near)
    assert kept[5] == 1 and kept[7] == 2 and kept[500] == 1 and kept[501] + kept[502] + kept[None] == 1
    assert out["sharding"].count() == out["mixing"].count() > 0
