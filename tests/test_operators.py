"""Operators of retrieval, versions, chunks, routing, evaluation and validation."""

import math
import random
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from granary import batches, schema
from granary.functions import text as T
from granary.operators import chunks, evaluation, filters, retrieval, routing, tools, validation, versions


def ranked_list(spark, ids):
    return spark.createDataFrame([("q", c, i, 1.0 / i) for i, c in enumerate(ids, 1)], "query_id string, chunk_id string, rank int, score double")


@pytest.fixture(scope="module")
def chunk_rows(spark):
    rows = [("c1", "r1", "매출액 증가 보고", "삼성", "periodic", "20240101", True, False), ("c2", "r2", "영업이익 감소 매출액", "SK", "major", None, None, True), ("c3", "r3", "배당 공시", "SK", "periodic", "20230101", False, False)]
    df = spark.createDataFrame(rows, "chunk_id string, report_id string, text string, company string, report_type string, filing_date string, is_latest boolean, is_correction boolean")
    return df.withColumn("report_subtype", F.lit("annual")).withColumn("period", F.lit("2024")).withColumn("report_name", F.lit("n")).withColumn("section_path", F.array(F.lit("s")))


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, text string")


def test_bm25(spark, chunk_rows):
    index = retrieval.build_bm25(chunk_rows)
    hits = retrieval.bm25_search(index, chunk_rows, asked(spark, "매출액", ""), 10).collect()
    assert {h.chunk_id for h in hits} == {"c1", "c2"} and {h.query_id for h in hits} == {"q0"}
    n, mean = 3, 8 / 3
    idf = math.log(1 + (n - 2 + 0.5) / 2.5)
    assert abs(hits[0].score - idf * 1 / (1 + 1.5 * (0.25 + 0.75 * 3 / mean))) < 1e-9
    twice = {r.chunk_id: r.score for r in retrieval.bm25_scores(index, asked(spark, "매출액 매출액")).collect()}
    once = {r.chunk_id: r.score for r in retrieval.bm25_scores(index, asked(spark, "매출액 매출액"), count_repeats=False).collect()}
    assert abs(twice["c1"] - 2 * once["c1"]) < 1e-9
    kept = retrieval.bm25_search(index, chunk_rows, asked(spark, "매출액"), 10, filters.RetrievalFilter(companies=["SK"])).collect()
    assert [h.chunk_id for h in kept] == ["c2"]


def test_filters(chunk_rows):
    ids = lambda f, dense=False: {r.chunk_id for r in filters.apply(chunk_rows, f, dense).collect()}
    assert ids(None) == ids(filters.RetrievalFilter()) == {"c1", "c2", "c3"}
    assert ids(filters.RetrievalFilter(latest_only=True)) == {"c1", "c2"} and ids(filters.RetrievalFilter(latest_only=True), True) == {"c1"}
    assert ids(filters.RetrievalFilter(filing_date_from="20230601")) == {"c1"} and ids(filters.RetrievalFilter(filing_date_to="20230601")) == {"c2", "c3"}
    assert ids(filters.RetrievalFilter(include_corrections=False)) == {"c1", "c3"}
    assert ids(filters.RetrievalFilter(report_ids=["r1"]), True) == {"c1", "c2", "c3"}


def test_relaxation(chunk_rows):
    rows = chunk_rows.withColumn("query_id", F.lit("q")).withColumn("score", F.lit(1.0))
    out = filters.first_nonempty(rows, filters.relaxations("SK", "periodic", "1999", True), 5).collect()
    assert {(r.chunk_id, r.attempt) for r in out} == {("c3", 2)}
    assert [len(filters.relaxations(*a)) for a in [("SK", None, None, False), ("SK", "periodic", "2024", True)]] == [1, 4]


def test_fusion(spark):
    a, b = ranked_list(spark, ["a", "b", "c"]), ranked_list(spark, ["c", "b"])
    out = [r.chunk_id for r in retrieval.rrf([a, b]).orderBy("rank").collect()]
    assert out.index("b") < out.index("a") and len(out) == len(set(out)) == 3
    w = {r.chunk_id: r.score for r in retrieval.weighted_fusion(a, b).collect()}
    assert w["a"] == 0.5 and w["c"] == 0.5 and 0 < w["b"] < 0.5


def test_dense_and_hybrid(spark, chunk_rows):
    vectors = spark.createDataFrame([("c1", [1.0, 0.0], "삼성"), ("c2", [0.0, 1.0], "SK"), ("c3", [0.0, 0.0], "SK")], "chunk_id string, vec array<float>, company string")
    q = spark.createDataFrame([("q0", [1.0, 0.0])], "query_id string, vec array<float>")
    assert [r.chunk_id for r in retrieval.dense_search(vectors, q, 1).collect()] == ["c1"]
    assert [r.chunk_id for r in retrieval.dense_search(vectors, q, 5, filters.RetrievalFilter(companies=["SK"])).collect()] == ["c2"]
    index = retrieval.build_bm25(chunk_rows)
    lexical = [r.chunk_id for r in retrieval.bm25_search(index, chunk_rows, asked(spark, "매출액"), 5).orderBy("rank").collect()]
    assert [r.chunk_id for r in retrieval.hybrid_search(index, chunk_rows, None, asked(spark, "매출액"), 5).orderBy("rank").collect()] == lexical
    both = asked(spark, "배당").join(q, "query_id")
    assert {r.chunk_id for r in retrieval.hybrid_search(index, chunk_rows, vectors, both, 5).collect()} == {"c1", "c2", "c3"}
    top = retrieval.hybrid_search(index, chunk_rows, vectors, both, 1, rerank_score=F.length("text").cast("double")).collect()
    assert len(top) == 1


FILING = "doc_id string, corp_name string, flr_nm string, doc_group string, doc_subtype string, base_year int, base_month int, report_nm string, is_correction boolean, rcept_no string, rcept_dt string, file_format string"


def filing(i, group, date, correction=False, title="보고서", corp="A", fmt="xml", filer=None):
    return (i, corp, filer, group, "annual", 2024, 12, title, correction, i, date, fmt)


def test_version_chains(spark):
    note = lambda d, t="보고서": f"<P>1. 정정대상 공시서류 : {t} 2. 정정대상 공시서류의 최초제출일 : {d}</P>"
    rows = [
        filing("m1", "major", "20240101"), filing("m2", "major", "20240201", True), filing("m3", "major", "20240301", True), filing("m4", "major", "20240401", True),
        filing("u", "major", "20240501", True), filing("pdf", "major", "20240601", True, fmt="pdf+html"), filing("ov", "major", "20240701", True),
        filing("t1", "major", "20230101", title="단일판매 계약", corp="B"), filing("t2", "major", "20230101", title="유상증자 결정", corp="B"), filing("t3", "major", "20230301", True, title="[기재정정]유상증자 결정", corp="B"),
        filing("p1", "periodic", "20240101"), filing("p2", "periodic", "20240301", True), filing("h1", "holding", "20240101", filer="x"), filing("h2", "holding", "20240101", filer="y"), filing("h3", "holding", "20240201", True, filer="y"),
    ]
    texts = [("m2", note("2024년 1월 1일")), ("m3", note("2024-02-01")), ("m4", note("2024.03.01")), ("u", note("1999.01.01")), ("ov", "nothing"), ("t3", note("2023.01.01", "유상증자 결정")), ("h3", note("2024.01.01"))]
    index = versions.correction_index(spark.createDataFrame(rows, FILING), spark.createDataFrame(texts, "doc_id string, text string"), spark.createDataFrame([("ov", "20240401")], "doc_id string, target_date string"))
    out = {r.doc_id: r for r in index.collect()}
    assert len(out) == len(rows)
    assert [out[f"m{i}"].correction_order for i in (1, 2, 3, 4)] == [0, 1, 2, 3] and {out[f"m{i}"].correction_group_id for i in (1, 2, 3, 4)} == {"m1"}
    assert out["ov"].correction_group_id == "m1" and out["ov"].resolution_source == "manual_override" and out["ov"].is_latest
    assert out["u"].resolution_source == "unresolved" and out["u"].correction_group_id == "u" and out["u"].is_latest
    assert out["pdf"].resolution_source == "unsupported_format"
    assert out["t3"].correction_group_id == "t2" and out["t3"].resolution_source == "fuzzy_tiebreak"
    assert out["p2"].correction_group_id == "p1" and out["p1"].resolution_source == "manifest_key" and out["h3"].correction_group_id == "h2"
    latest = {}
    for r in out.values():
        latest[r.correction_group_id] = latest.get(r.correction_group_id, 0) + r.is_latest
    assert set(latest.values()) == {1}


def test_texts_are_read_once_for_all_groups(spark):
    read = spark.sparkContext.accumulator(0)

    def reads(text):
        read.add(1)
        return text

    rows = [filing(f"{g}{i}", g, f"2024010{i}", i > 1, filer="x") for g in ("major", "exchange", "holding", "periodic") for i in (1, 2, 3)]
    texts = spark.createDataFrame([(r[0], f"정정대상 공시서류의 최초제출일 : 2024.01.0{int(r[0][-1]) - 1}") for r in rows if r[8]], "doc_id string, text string")
    index = versions.correction_index(spark.createDataFrame(rows, FILING), texts.select("doc_id", F.udf(reads, "string")("text").alias("text")))
    assert {(r.doc_id[:-1], r.correction_order) for r in index.collect() if r.correction_group_id == r.doc_id[:-1] + "1"} == {(g, i) for g in ("major", "exchange", "holding", "periodic") for i in range(3)}
    assert read.value == 8


def test_filings_that_name_their_own_date(spark):
    """A filing isn't its own candidate, null keys are equal, and groups and filers don't mix."""
    rows = [filing("a", "major", "20240101", corp=None), filing("b", "major", "20240101", True, corp=None), filing("c", "major", "20240101", True, corp="C"), filing("d", "major", "20240101", corp="D"), filing("e", "major", "20240101", corp="D"), filing("f", "major", "20240101", True, corp="D", title="다른 것")]
    rows += [filing("x", "exchange", "20240101", corp="C"), filing("h", "holding", "20240101", corp=None), filing("i", "holding", "20240101", corp=None, filer="y"), filing("j", "holding", "20240101", True, corp=None)]
    texts = [(i, "정정대상 공시서류의 최초제출일 : 2024.1.1") for i in "bcfj"]
    index = versions.correction_index(spark.createDataFrame(rows, FILING), spark.createDataFrame(texts, "doc_id string, text string"))
    got = {r.doc_id: (r.correction_group_id, r.resolution_source) for r in index.collect()}
    assert len(got) == len(rows) and got["b"] == ("a", "rule") and got["c"] == ("c", "unresolved") and got["j"] == ("h", "rule")
    assert got["f"] == ("f", "unresolved")  # of two candidates none is like the title that isn't named


def test_cycles_and_long_chains(spark):
    links = [(str(i), str(i - 1) if i else None) for i in range(100)] + [("x", "y"), ("y", "x"), ("z", "x")]
    out = {r.doc_id: r.root for r in versions.roots(spark.createDataFrame(links, "doc_id string, parent string")).collect()}
    assert {out[str(i)] for i in range(100)} == {"0"} and out["x"] == "x" and out["y"] == "y" and out["z"] == "x"


def cell(text, header=False, code=None, unit=None):
    return {"text": text, "is_header": header, "field_code": code, "unit_code": unit, "unit_value": None}


def test_table_pieces():
    rows = [[cell("h", True), cell("i", True)]] + [[cell(str(i)), cell("v")] for i in range(45)]
    pieces = chunks.render_table(rows, "title", "unit")
    assert len(pieces) == 3 and all(p.startswith("title\nunit\nh | i\n") for p in pieces)
    assert chunks.render_table([[cell("only")]]) == ["only"] and chunks.render_table([]) == []
    assert len(chunks.render_table([[cell("x" * 900)] for _ in range(6)])) > 2


def test_packing():
    text = lambda n: {"kind": "text", "text": "x" * n, "rows": [], "pairs": []}
    assert [len(u[0]) for u in chunks.pack([text(800), text(800), text(10)])] == [1602, 10]
    assert len(chunks.pack([text(5000)])) == 1
    pairs = {"kind": "key_value", "group_label": "g", "pairs": [{"key": "k", "value": "v", "field_code": "C", "unit_code": None}], "rows": []}
    table = {"kind": "table", "rows": [[cell("a", True), cell("b"), cell("1", code="F")]], "title_hint": None, "unit_hint": None, "pairs": []}
    (unit,) = chunks.pack([text(4), table, pairs])
    assert unit[1] == "key_value" and unit[2] == {"1": "F", "k": "C"} and "[g]\n- k: v" in unit[0]
    big = {"kind": "table", "rows": [[cell(str(i)), cell("v")] for i in range(60)], "title_hint": None, "unit_hint": None, "pairs": []}
    assert [u[1] for u in chunks.pack([text(4), big, text(4)])] == ["text", "table", "table", "table", "text"]


def test_packing_by_brute_force():
    """Against a plain loop that holds one open unit."""
    rng = random.Random(9)
    for _ in range(200):
        nodes = []
        for _ in range(rng.randint(0, 12)):
            if rng.random() < 0.4:
                nodes.append({"kind": "table", "rows": [[cell("y" * rng.choice([1, 30, 300])), cell("v")] for _ in range(rng.randint(1, 9))], "title_hint": None, "unit_hint": None, "pairs": []})
            else:
                nodes.append({"kind": "text", "text": "x" * rng.choice([0, 3, 200, 700, 1100, 2500]), "rows": [], "pairs": []})
        want, held = [], []
        size = lambda: sum(map(chunks.tokens, held))
        for node in nodes:
            pieces = chunks.render_table(node["rows"]) if node["kind"] == "table" else [node["text"]] if node["text"] else []
            fits = len(pieces) == 1 and size() + chunks.tokens(pieces[0]) <= 1000
            if node["kind"] == "table" and not fits:
                want += ([held] if held else []) + [[p] for p in pieces]
                held = []
                continue
            if pieces and held and not fits:
                want.append(held)
                held = []
            held = held + pieces
            if held and size() >= 600:
                want.append(held)
                held = []
        want += [held] if held else []
        assert [u[0] for u in chunks.pack(nodes)] == ["\n\n".join(u) for u in want]


def test_packing_holds_a_slice_only(spark, monkeypatch):
    """A batch of many sections is packed a slice at a time, whatever its size."""
    taken = []
    monkeypatch.setattr(chunks, "map_rows", lambda df, rows, ddl: taken.append((rows, ddl)))
    line = {"kind": "text", "text": "x" * 60, "title_hint": None, "unit_hint": None, "rows": None, "group_label": None, "pairs": None, "section_seq": 0, "section_title": "S", "section_path": ["S"]}
    chunks._packed(spark.createDataFrame([], schema.NODE), True, False, True)
    ((rows, ddl),) = taken
    one = {"doc_id": "0", "report_subtype": "main", "source_path": "p", "document_name": "n", "section_seq": 0, "nodes": [{**line, "node_seq": i} for i in range(10)]}
    batch = pa.RecordBatch.from_pylist([one] * 8000)
    tracemalloc.start()
    sizes = [b.num_rows for b in batches.through(rows, to_arrow_schema(StructType.fromDDL(ddl)))(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 16000 and max(sizes) < 1600 and peak < 16e6
    assert [p.num_rows for p in batches.slices(batch.slice(0, 5), 1)] == [1] * 5 and not list(batches.slices(batch.slice(0, 0)))


def test_contents_tables(spark):
    kind = "array<array<struct<text:string,is_header:boolean,field_code:string,unit_code:string,unit_value:string>>>"
    toc = [[cell("t"), cell("-" * 30), cell("3")]] * 3
    data = [[cell("t"), cell("-"), cell("3")]] * 3
    rows = spark.createDataFrame([(1, toc), (2, data), (3, toc[:2])], f"i int, rows {kind}")
    assert {r.i for r in rows.where(chunks.is_contents_table(F.col("rows"))).collect()} == {1}


def test_leaves_and_windows(spark):
    rows = spark.createDataFrame([("p", None), ("c", "p"), ("d", "p"), ("e", None)], "chunk_id string, parent_chunk_id string")
    assert {r.chunk_id for r in chunks.leaves(rows).collect()} == {"c", "d", "e"}
    out = chunks.fixed_windows(spark.createDataFrame([("a", "x" * 25 + " " * 20 + "y"), ("b", ""), ("c", None)], "doc_id string, text string"), 5).collect()
    assert [(r.doc_id, r.window, len(r.piece)) for r in out] == [("a", 0, 10), ("a", 1, 10), ("a", 2, 5), ("a", 4, 1)]


def test_search_text(spark):
    row = spark.createDataFrame([("A", None, "2024", ["s", "t"], "body")], "c string, r string, p string, s array<string>, b string")
    assert row.select(chunks.render_search_text(*[F.col(c) for c in "crpsb"])).first()[0] == "[회사]\nA\n\n[기간]\n2024\n\n[Section]\ns > t\n\n[내용]\nbody"


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 3), ("q", "z", 4)], "query_id string, report_id string, rank int")
    gold = spark.createDataFrame([("q", ["a", "b", "c"]), ("e", []), ("n", ["x"])], "query_id string, gold array<string>")
    out = {r.query_id: r for r in evaluation.per_query(ranked, gold).collect()}
    assert abs(out["q"].recall - 2 / 3) < 1e-9 and out["q"].rr == 1.0 and out["q"].ndcg <= 1 and out["q"].hit
    assert out["e"].recall == out["e"].ndcg == 0 and out["n"].rr == 0 and not out["n"].hit
    values = evaluation.p95(spark.createDataFrame([("g", float(i)) for i in range(1, 31)], "g string, v double"), "g", "v").select(F.col("v").alias("x"))
    assert values.first().x == 28.0


def test_classification(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), (None, None)], "expected string, predicted string")
    out = evaluation.classification(rows).first()
    assert out.accuracy == 0.5 and out.fallback_rate == 0.5 and abs(out.macro_f1 - (2 / 3 + 0 + 2 / 3) / 3) < 1e-9
    amb = evaluation.ambiguous(spark.createDataFrame([("a", ["a", "b"]), (None, ["a"]), ("c", ["a"])], "predicted string, acceptable array<string>")).first()
    assert abs(amb.appropriate_rate - 2 / 3) < 1e-9 and abs(amb.forced_wrong_rate - 1 / 3) < 1e-9


def test_many_queries_meet_in_blocks(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(900, [0.0] * 6), (901, [1.0]), (902, None)]
    df = spark.createDataFrame(vectors, "chunk_id long, vec array<double>")
    asked = df.where("chunk_id < 100").withColumnRenamed("chunk_id", "query_id")
    key = lambda r: (r.query_id, r["rank"], r.chunk_id, round(r.score, 9))
    one = sorted(map(key, retrieval.dense_top(df, asked, 4).collect()))
    assert sorted(map(key, retrieval.dense_top(df, asked, 4, block=30).collect())) == one and len(one) == 400
    assert retrieval.dense_top(df, asked.limit(0), 4).count() == 0


def test_nearest_holds_tiles_only():
    rng = np.random.default_rng(3)
    asked, rows = rng.normal(size=(2000, 4)), np.repeat(rng.normal(size=(200, 4)), 100, axis=0)
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), 4).cast(pa.list_(pa.float64()))
    solve = retrieval._nearest(pa.array(range(2000)), asked, 3, 9, schema)
    tracemalloc.start()
    out = pa.Table.from_batches(list(solve(iter([pa.RecordBatch.from_arrays([pa.array(range(20000)), vectors], names=["chunk_id", "vec"])]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all scores are 320 MB
    assert out.num_rows == 6000  # a hundred copies tie, the smaller ids are kept
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.argmax(unit(asked) @ unit(rows).T.round(12), axis=1) // 100 * 100
    got = out.to_pandas().groupby("query_id")["chunk_id"].apply(sorted)
    assert all(got[i] == [best[i], best[i] + 1, best[i] + 2] for i in range(2000))


@pytest.mark.parametrize("name", ["whitespace", "char_1gram", "char_2gram", "char_3gram"])
def test_search_in_place_ranks_like_all_scores(spark, name, monkeypatch):
    monkeypatch.setattr(retrieval, "STRETCH", 64)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd\U0001f600é") for _ in range(rng.randint(1, 4)))
    texts = ["", None, " ", "a", " b\u3000", *[rng.choice([" ", "\n\t", "\x1c"]).join(word() for _ in range(rng.randint(1, 30))) for _ in range(200)]]
    docs = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate([*texts, *texts])], "chunk_id long, text string, g int").repartition(3)
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "", "zz", *texts[20:40]])], "query_id long, text string")
    scores = retrieval.bm25_scores(retrieval.build_bm25(docs, name), queries, name).withColumn("score", F.round("score", 9))
    want = sorted(retrieval.ranked(scores, 7).select("query_id", "chunk_id", "score", "rank").collect())
    assert sorted(retrieval.bm25_top(docs, queries, 7, name).collect()) == want and want
    monkeypatch.setattr(retrieval, "PLACED_QUERIES", 2)  # beyond the bound: by postings
    assert sorted(retrieval.bm25_top(docs, queries, 7, name).collect()) == want
    monkeypatch.undo()
    some = retrieval.ranked(scores.join(docs.where("g <> 1").select("chunk_id"), "chunk_id"), 7).select("query_id", "chunk_id", "score", "rank")
    assert sorted(retrieval.bm25_top(docs, queries, 7, name, where=F.col("g") != 1).collect()) == sorted(some.collect())
    by = retrieval.bm25_top(docs, queries, 7, name, by=F.col("g"), groups=3)
    for g in range(3):
        each = retrieval.ranked(scores.join(docs.where(F.col("g") == g).select("chunk_id"), "chunk_id"), 7).select("query_id", "chunk_id", "score", "rank")
        assert sorted(by.where(F.col("by") == g).drop("by").collect()) == sorted(each.collect())


def test_sums_and_statistics_in_place(spark, chunk_rows):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(90, [0.0] * 5)], "chunk_id long, vec array<double>").repartition(3)
    asked = df.where("chunk_id < 20").withColumnRenamed("chunk_id", "query_id")
    want = {r.query_id: (r.n, round(r.t, 9)) for r in retrieval.dense_scores(df, asked).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("score").alias("t")).collect()}
    assert {r.query_id: (r.n, round(r.total, 9)) for r in retrieval.dense_sums(df, asked, block=7).collect()} == want and len(want) == 20
    counts = retrieval.postings(chunk_rows, T.whitespace_tokens).groupBy("term").agg(F.count("*"), F.max("tf"), F.sum("tf"))
    assert sorted(retrieval.term_statistics(chunk_rows, T.whitespace_tokens).collect()) == sorted(counts.collect())
    flt = filters.RetrievalFilter(companies=["SK"])
    found = [[(r.chunk_id, r["rank"]) for r in retrieval.bm25_search(ix, chunk_rows, asked_text, 2, flt).collect()] for asked_text in [asked_one(spark)] for ix in (None, retrieval.build_bm25(chunk_rows))]
    assert found[0] == found[1] and found[0]


def asked_one(spark):
    return asked(spark, "매출액 배당")


def test_ordered_values(spark):
    rng = random.Random(5)
    rows = [("a" if rng.random() < 0.8 else "b", rng.randrange(100)) for _ in range(2000)] + [("c", 7), ("d", None)]
    out = {r.g: (r.n, r.v) for r in evaluation.p95(spark.createDataFrame(rows, "g string, v int").repartition(5), "g", "v").collect()}
    for g in "abc":
        held = sorted(v for x, v in rows if x == g)
        assert out[g] == (len(held), held[max(0, int(len(held) * 0.95) - 1)])
    assert "d" not in out


def test_stored_index_gives_the_same_scores(spark, chunk_rows, tmp_path):
    asked = spark.createDataFrame([("q", "매출액 배당"), ("r", "none")], "query_id string, text string")
    plain = retrieval.bm25_scores(retrieval.build_bm25(chunk_rows), asked).collect()
    stored = retrieval.build_bm25(chunk_rows, path=str(tmp_path / "index"))
    scores = retrieval.bm25_scores(stored, asked)
    assert sorted((r.chunk_id, round(r.score, 12)) for r in plain) == sorted((r.chunk_id, round(r.score, 12)) for r in scores.collect()) and plain
    assert "In(term" in scores._jdf.queryExecution().toString()


def test_routing(spark):
    examples = spark.createDataFrame([("u1", "x", [1.0, 0.0]), ("u2", "x", [0.9, 0.1]), ("u3", "y", [0.0, 1.0])], "utterance_id string, route string, vec array<float>")
    q = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.7, 0.7])], "query_id string, vec array<float>")
    out = {r.query_id: r for r in routing.cascade(routing.decide(routing.route_scores(examples, q, "max"), 0.5), F.lit("second"), 0.1).collect()}
    assert out["q1"].route == "x" and not out["q1"].escalated and out["q2"].escalated and out["q2"].route == "second"
    assert routing.no_route(q).first().route is None
    labels = spark.createDataFrame([("calculation ",), ("unclear",), ("x",)], "a string").select(routing.parse_label(F.col("a")).alias("r")).collect()
    assert [r.r for r in labels] == ["calculation", None, None]


ANSWER = "answer string, prompt_text string, tool_results array<string>, citations array<struct<report_id:string,chunk_id:string,is_correction:boolean>>, explicit_correction boolean"


def check(spark, answer, prompt, tool_results=(), citations=(("r1", "c1", False),), correction=False):
    return validation.validate(spark.createDataFrame([(answer, prompt, list(tool_results), list(citations), correction)], ANSWER)).first().validation


def test_validation(spark):
    assert check(spark, "999999999 (r1)", "100,000").ungrounded_numbers == ["999999999"]
    v = check(spark, "368,794 증가 r1", "2,164,043 and 1,795,249")
    assert v.passed and v.verified_derived_numbers == {"368794": "2164043 - 1795249"}
    assert not check(spark, "1,234,567 r1", "2,164,043 and 1,795,249").numbers_grounded
    assert check(spark, "2023년 r1", "(2023.12)").numbers_grounded
    assert check(spark, "근거 있음", "x").has_citation and not check(spark, "없음", "x").has_citation
    assert not check(spark, "근거", "x", citations=()).has_citation
    assert check(spark, "major_20250828001452", "x", ["{'doc_id': 'major_20250828001452'}"], ()).has_citation
    assert check(spark, "r1", "x", correction=True).correction_evidence_complete is False
    assert check(spark, "r1", "x", citations=(("r1", "c1", False), ("r2", "c2", True)), correction=True).passed


def test_reports(spark):
    rows = spark.createDataFrame([("a", "1", True), ("a", "2", False), ("b", "3", True)], "doc_group string, doc_id string, resolved boolean")
    out = {r.doc_group: r for r in validation.resolution_report(rows).collect()}
    assert (out["a"].total, out["a"].n_resolved) == (2, 1) and not out["a"].healthy and out["b"].healthy
    assert [tuple(r) for r in validation.failures(rows).collect()] == [("a", "2")]
    names = spark.createDataFrame([("x",), ("y",)], "name string")
    assert {tuple(r) for r in validation.name_report(names, spark.createDataFrame([("y",), ("z",)], "name string")).collect()} == {("y", "matched"), ("x", "missing"), ("z", "extra")}


def test_agent_loop(spark):
    seen = []

    class Client:
        def __init__(self):
            self.turn = 0

        def chat(self, messages, schemas):
            self.turn += 1
            seen.append(list(messages))
            call = {"name": "calculate_growth_rate", "arguments": {"before": 100, "after": 150}}
            return {"calls": [call, call, {"name": "nothing", "arguments": {}}]} if self.turn == 1 else {"text": "50%"}

    trace = tools.run_agent("q", Client(), tools.Registry(tools.calculation_tools(spark)), "hint")
    assert trace.answer == "50%" and [c["name"] for c in trace.calls] == ["calculate_growth_rate", "calculate_growth_rate", "nothing"] and trace.stop == tools.ANSWERED and trace.turns == 2
    assert trace.calls[0]["result"]["value"] == 50.0 and "note" not in trace.calls[0]["result"] and "error" in trace.calls[2]["result"]
    assert trace.calls[1]["result"] == {**trace.calls[0]["result"], "note": tools.REPEATED}
    roles = [m["role"] for m in seen[-1]]
    assert roles == ["system", "user", "assistant", "tool", "tool", "tool"] and seen[-1][1]["content"] == "hint\n\nq"
    assert [m["tool_call_id"] for m in seen[-1][3:]] == [c["id"] for c in seen[-1][2]["calls"]] and len({c["id"] for c in seen[-1][2]["calls"]}) == 3
    pack = tools.evidence_pack(trace)
    assert "계산 종류: calculate_growth_rate\n입력 값: {'before': 100, 'after': 150}\n결과: {'value': 50.0" in pack.prompt_text and len(pack.tool_results) == 3
    assert tools.evidence_pack(tools.Trace("q")).prompt_text == "[USER QUESTION]\nq\n\n[EVIDENCE 없음 — 검색/도구 호출로 근거를 확보하지 못했습니다]"
    hit = {"chunk_id": "c1", "report_id": "r1", "company": "회사", "report_name": None, "filing_date": "20240101", "period": None, "section_path": ["a", "b"], "is_correction": True, "is_latest": True, "text": "t", "score": 1.5}
    searches = tools.Trace("q", [{"name": tools.SEARCH, "arguments": {}, "result": {"results": [hit, {**hit, "chunk_id": "c2", "is_correction": False, "is_latest": None}]}}, {"name": "x", "arguments": {}, "result": {"a": "가"}}, {"name": tools.SEARCH, "arguments": {}, "result": {"results": [hit]}}])
    pack = tools.evidence_pack(searches)
    first = "[EVIDENCE 1]\n회사: 회사\n공시명: None\n공시일: 20240101\n기간: None\nSection: a > b\n정정 상태: 정정본 (최신)\n내용:\nt\nreport_id: r1\nchunk_id: c1\n"
    assert pack.prompt_text.startswith("[USER QUESTION]\nq\n\n" + first + "\n[EVIDENCE 2]") and '\n[TOOL RESULT]\nx: {"a": "가"}\n\n[EVIDENCE 3]' in pack.prompt_text and "정정 상태: 원본\n" in pack.prompt_text
    assert [c["chunk_id"] for c in pack.citations] == ["c1", "c2", "c1"] and pack.citations[0]["section_path"] == ["a", "b"] and len(pack.tool_results) == 1


def test_agent_stops(spark):
    class Busy:
        def chat(self, messages, schemas):
            return {"calls": [{"name": "nothing", "arguments": {"n": len(messages)}}]}

    trace = tools.run_agent("q", Busy(), tools.Registry([]))
    assert trace.stop == tools.OUT_OF_TURNS and trace.turns == 6 and trace.answer is None and len(trace.calls) == 6


def test_version_tools(spark):
    rows = [("a", "회사", "사업보고서", "annual", "periodic", "20240101", "1", False, "g1", 0, False, "manifest_key"), ("b", "회사", "[기재정정]사업보고서", "annual", "periodic", "20240201", "2", True, "g1", 1, True, "rule"), ("c", "회사", "분기보고서", "quarter", "periodic", "20230101", "3", False, "g2", 0, True, "manifest_key"), ("d", "other", "x", "annual", "periodic", "20250101", "4", False, "g3", 0, True, "original")]
    filings = spark.createDataFrame(rows, "doc_id string, corp_name string, report_nm string, doc_subtype string, doc_group string, rcept_dt string, rcept_no string, is_correction boolean, correction_group_id string, correction_order int, is_latest boolean, resolution_source string")
    history, latest = (t.handler for t in tools.version_tools(filings))
    name = unicodedata.normalize("NFD", "회사")
    groups = history(name)["correction_groups"]
    assert [g["correction_group_id"] for g in groups] == ["g1", "g2"] and [v["doc_id"] for v in groups[0]["chain"]] == ["a", "b"] and groups[0]["chain"][1]["resolution_source"] == "rule"
    assert [g["correction_group_id"] for g in history(name, "분기 보고서")["correction_groups"]] == ["g2"] and history("none") == {"correction_groups": []}
    assert latest(name, "periodic")["doc_id"] == "b" and latest(name, "major") == {"found": False} and latest(name, "periodic", "분기")["doc_id"] == "c"


def test_search_tool(spark, chunk_rows):
    index = retrieval.build_bm25(chunk_rows)

    def search(query, k, flt):
        return retrieval.bm25_search(index, chunk_rows, spark.createDataFrame([("q", query)], "query_id string, text string"), k, flt)

    tool = tools.search_tool(search)
    out = tool.handler(query="매출액", company="SK", report_type="periodic", period="1999")
    assert [r["chunk_id"] for r in out["results"]] == ["c2"] and out["note"]
    assert tool.handler(query="없는말")["results"] == []
    assert [r["report_id"] for r in tool.handler(query="매출액", report_id="r1")["results"]] == ["r1"]


def test_tokenizers_by_name():
    assert T.tokenizer("whitespace") is T.whitespace_tokens and callable(T.tokenizer("char_3gram"))
    for name in ("morphological", "char_gram"):
        with pytest.raises(ValueError):
            T.tokenizer(name)


def test_retries():
    waits, calls = [], []

    class Flaky:
        def chat(self, messages, schemas):
            calls.append(1)
            if len(calls) < 3:
                raise OSError("busy")
            return {"text": "ok"}

    assert tools.Retrying(Flaky(), sleep=waits.append).chat([], []) == {"text": "ok"} and waits == [3.0, 6.0]
    calls.clear()
    with pytest.raises(OSError):
        tools.Retrying(Flaky(), attempts=2, sleep=waits.append).chat([], [])


def test_embedding(spark, chunk_rows):
    out = retrieval.embed(chunk_rows, lambda t: F.array(F.length(t).cast("float"), F.lit(0.0).cast("float")), prefix="query: ").collect()
    assert all(abs(r.vec[0] - 1) < 1e-6 for r in out)
