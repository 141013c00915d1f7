"""Sources, parsers, sinks, streams and the whole plan, on small files."""

import http.server
import json
import random
import threading
import tracemalloc
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from granary import batches
from granary.functions import entities
from granary.operators import routing, tools
from granary.plans import ask, corpus
from granary.sources import chat, files, parsers, sinks
from granary.streaming import stream

XML = """<?xml version="1.0" encoding="utf-8"?><!-- note --><DOCUMENT><DOCUMENT-NAME>사업보고서</DOCUMENT-NAME><BODY><P>loose</P><LIBRARY>
<SECTION-1><TITLE>I. S&P 개요</TITLE><P>첫 문단 <신  설> 내용</P><TABLE><TR><TH ENG=""Other">키</TH><TD COLSPAN="3">값</TD></TR></TABLE>
<TABLE-GROUP ACLASS="G"><TABLE><TR><TH>a</TH><TH>b</TH><TH>c</TH><TH>d</TH></TR><TR><TE ACODE="X1">1</TE><TU AUNIT="U" AUNITVALUE="9">2</TU><TD>3</TD><TD>4</TD></TR></TABLE></TABLE-GROUP>
<SECTION-2><TITLE>가. 세부</TITLE><P>둘째</P><IMAGE><IMG-CAPTION>그림</IMG-CAPTION></IMAGE><PGBRK/></SECTION-2></SECTION-1></LIBRARY><SECTION-1><TITLE>II. 끝</TITLE><P>끝</P></SECTION-1></BODY></DOCUMENT>"""
HTML = "<html><head><title>계약</title></head><body><table><tr><td rowspan=2>계약내역</td><td>계약금액(원)</td><td>22,764,764,160,000</td></tr><tr><td>매출액대비(%)</td><td>7.6</td></tr></table></body></html>"


def test_html_references_end_in_a_semicolon():
    top = parsers.parse_html('<title>a &amp;&amp</title><a href="x?a=1&copy=2&amp;b">q &notit; &eacute;&#39; &#x41 & b</a><script>a&&b</script>')
    assert [e.text() for e in top.elements()] == ["a &&amp", "q &notit; é' &#x41 & b", "a&&b"]
    assert top.child("a").attributes["href"] == "x?a=1&copy=2&b"


def test_dart_parser():
    name, sections, warnings = parsers.parse_dart(XML)
    assert name == "사업보고서" and [s.title for s in sections] == ["I. S&P 개요", "가. 세부", "II. 끝", "사업보고서"] and warnings
    assert sections[1].path == ["I. S&P 개요", "가. 세부"] and sections[0].content[0]["text"] == "첫 문단 <신  설> 내용"
    kinds = [n["kind"] for n in sections[0].content]
    assert kinds == ["text", "key_value", "table"]
    table = sections[0].content[2]
    assert table["acode_group"] == "G" and table["rows"][1][0]["field_code"] == "X1" and table["rows"][1][1]["unit_value"] == "9"
    assert sections[1].content[1]["text"] == "[이미지: 그림 — 원문 참조]"
    assert parsers.parse_dart("")[1] == []


def test_escape(spark):
    row = spark.createDataFrame([("S&P &amp; <Manufacturing> <P>x</P>",)], "t string").select(parsers.escape(F.col("t"))).first()[0]
    assert row == "S&amp;P &amp; &lt;Manufacturing> <P>x</P>"


def test_exchange_parser():
    title, (section,), _ = parsers.parse_exchange(HTML)
    assert title == "계약"
    (node,) = section.content
    assert node["group_label"] == "계약내역" and {p["key"]: p["value"] for p in node["pairs"]} == {"계약금액(원)": "22,764,764,160,000", "매출액대비(%)": "7.6"}


def spanning(text, rows=1, columns=1):
    return parsers.Spanning(parsers.cell(text), rows, columns)


def test_grid():
    C = spanning
    assert parsers.lay_out([[C("g", 2), C("x", 1, 2)], [C("y")], []]) == [[0, 1], [0, 2, -1], [-1]]
    assert parsers.lay_out([]) == [] and parsers.lay_out([[C("a", 3)], [], [C("b")]]) == [[0, -1], [0, -1], [0, 1]]
    # a cell from above beyond a gap waits for the row that comes to it
    assert parsers.lay_out([[C("a"), C("b"), C("c", 2)], [C("d")], [C("e"), C("f")]]) == [[0, 1, 2], [3, -1], [4, 5, 2]]
    nodes = parsers.table_nodes([[C("k"), C("v", 1, 3)], [C("title")], [C("k2"), C("v2")]])
    assert [p["value"] for n in nodes for p in n["pairs"]] == ["v", "v2"]
    rng = random.Random(1)
    for _ in range(50):  # every cell is somewhere
        rows = [[C(str(rng.random()), rng.randint(1, 3), rng.randint(1, 3)) for _ in range(rng.randint(0, 4))] for _ in range(5)]
        assert {n for r in parsers.lay_out(rows) for n in r} - {-1} == set(range(sum(map(len, rows))))


def test_key_value_runs():
    C = spanning
    rows = [[C("g", 2), C("a"), C("1")], [C("b"), C("2")], [C(" ")], [C("k"), C("v")], [C("l"), C("w")], [C("h"), C("c"), C("3")], [C("", 2), C("d"), C("4")], [C("e"), C("")], [C("m"), C("x")]]
    nodes = parsers.table_nodes(rows)
    assert [(n["group_label"], [(p["key"], p["value"]) for p in n["pairs"]]) for n in nodes] == [
        ("g", [("a", "1"), ("b", "2")]), (None, [("k", "v"), ("l", "w")]), ("h", [("c", "3")]), (None, [("d", "4"), ("e", ""), ("m", "x")]),
    ]


def test_long_tables(spark):
    xml = "<DOCUMENT><BODY><SECTION-1><TITLE>t</TITLE><TABLE>" + "".join(f"<TR><TD>k{i}</TD><TD>v</TD></TR>" for i in range(600)) + "</TABLE></SECTION-1></BODY></DOCUMENT>"
    count = lambda parsed: sum(len(n["pairs"]) for s in parsed[1] for n in s.content)
    assert count(parsers.parse_dart(xml)) == 500 and count(parsers.parse_dart(xml, None)) == 600
    assert parsers.parse_dart(xml)[2] == ["table cut after 500 of 600 rows"] and parsers.parse_dart(xml, None)[2] == []
    files = spark.createDataFrame([("d", "major", "xml", True, "p", bytearray(xml.encode()))], "doc_id string, doc_group string, file_format string, is_main boolean, path string, content binary")
    assert [r.warning for r in parsers.warnings(files).collect()] == ["table cut after 500 of 600 rows"] and not parsers.warnings(files, None).collect()
    assert sum(len(r.pairs) for r in parsers.parse(files, None).collect()) == 600


def test_parsing_holds_a_slice_only(spark, monkeypatch):
    """Nodes go out with the slice of files that they come from, not with the whole batch."""
    taken = []
    monkeypatch.setattr(parsers, "map_rows", lambda df, rows, ddl: taken.append((rows, ddl)))
    parsers.parse(spark.createDataFrame([], "doc_id string, doc_group string, file_format string, is_main boolean, path string, content binary"))
    ((rows, ddl),) = taken
    body = HTML.replace("<table>", "<p>" + "x" * 1000 + "</p><table>").encode()
    batch = pa.RecordBatch.from_pylist([{"doc_id": "d", "doc_group": "exchange", "is_main": True, "path": "p", "content": body}] * 4000)
    tracemalloc.start()
    sizes = [b.num_rows for b in batches.through(rows, to_arrow_schema(StructType.fromDDL(ddl)))(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 4000 and max(sizes) < 400 and peak < 4e6


def write_corpus(root):
    manifest = []
    for i, (group, correction, date, body) in enumerate([("periodic", False, "20240301", XML), ("periodic", True, "20240401", XML), ("exchange", False, "20240101", HTML), ("major", False, "20240105", XML.replace("BODY", "BODY"))]):
        no = f"2024{i:010d}"
        path = unicodedata.normalize("NFD", f"raw/{group}/회사/{no}")
        (root / path).mkdir(parents=True)
        (root / path / f"{no}.xml").write_text(body, encoding="utf-8")
        manifest.append({"doc_id": f"{group}_{no}", "corp_code": "00126380", "corp_name": unicodedata.normalize("NFD", "회사"), "stock_code": "005930", "doc_group": group, "doc_subtype": "annual", "report_nm": "사업보고서", "is_correction": correction, "rcept_no": no, "rcept_dt": date, "base_year": 2023, "base_month": 12, "file_path": f"raw/{group}/회사/{no}"})
    (root / "manifest.jsonl").write_text("\n\n".join(json.dumps(m, ensure_ascii=False) for m in manifest), encoding="utf-8")
    return manifest


def test_corpus_plan(spark, tmp_path):
    manifest = write_corpus(tmp_path)
    built = corpus.build(spark, str(tmp_path / "manifest.jsonl"), str(tmp_path / "raw"))
    rows = built.chunks.collect()
    assert {r.report_id for r in rows} == {m["doc_id"] for m in manifest} and all(r.company == "회사" and r.corp_code == "00126380" for r in rows)
    ids = {r.chunk_id: r for r in rows}
    for r in rows:
        if r.parent_chunk_id:
            assert ids[r.parent_chunk_id].section_path == r.section_path
    leaf = {r.chunk_id for r in built.leaves.collect()}
    assert leaf.isdisjoint({r.parent_chunk_id for r in rows}) and leaf
    exchange = [r for r in rows if r.report_type == "exchange"]
    assert len(exchange) == 1 and exchange[0].content_type == "key_value" and "- 매출액대비(%): 7.6" in exchange[0].raw_text
    latest = {r.report_id: (r.correction_order, r.is_latest) for r in rows if r.report_type == "periodic"}
    assert sorted(latest.values()) == [(0, False), (1, True)]
    assert all(r.healthy for r in built.health.collect())
    assert any("[기간]\n2023-12" in r.text for r in rows) and any(r.field_codes.get("1") == "X1" for r in rows if r.field_codes)
    assert {r.warning for r in parsers.warnings(files.main_files(files.raw_files(spark, str(tmp_path / "raw")), files.manifest(spark, str(tmp_path / "manifest.jsonl")))).collect()} == {"content outside of sections"}


def test_small_sources(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("﻿corp_code,corp_name,listed_name\n00126380,현대자동차,현대차\n".encode())
    row = files.universe(spark, str(tmp_path / "u.csv")).first()
    assert row.corp_code == "00126380" and row.listed_name == "현대차"
    (tmp_path / "t.txt").write_text("# c\n매출액\n\n매출\n", encoding="utf-8")
    assert [r.term for r in files.terms(spark, str(tmp_path / "t.txt")).orderBy("position").collect()] == ["매출액", "매출"]
    assert [r.position for r in files.terms(spark, str(tmp_path / "t.txt")).orderBy("position").collect()] == [1, 3]
    (tmp_path / "d.txt").write_text("영업이익\tNNP\t1.5\n배당\n", encoding="utf-8")
    assert [tuple(r) for r in files.user_dictionary(spark, str(tmp_path / "d.txt")).collect()] == [("영업이익", "NNP", 1.5), ("배당", "NNG", 0.0)]
    (tmp_path / "g.json").write_text('[{"id": 1, "gold_report_ids": ["a"]}]')
    assert files.gold(spark, str(tmp_path / "g.json")).first().gold_report_ids == ["a"]
    nfd = unicodedata.normalize("NFD", "회사/가")
    paths = spark.createDataFrame([("회사/가",), ("없음",)], "path string")
    out = {r.path: r.n_actual for r in files.resolve(paths, spark.createDataFrame([(nfd,), ("회사/가",), (".x/y",)], "path string")).collect()}
    assert out == {"회사/가": 2, "없음": 0}
    assert {r.name for r in files.folders(spark.createDataFrame([(nfd,), (".x/y",)], "path string")).collect()} == {"회사"}


def test_sinks(spark, tmp_path):
    rows = spark.range(10).selectExpr("cast(id as string) chunk_id", "'periodic' report_type")
    assert sinks.append_remaining(rows.limit(4), str(tmp_path / "v")) == 4
    assert sinks.append_remaining(rows, str(tmp_path / "v")) == 10
    sinks.vectors(rows, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 10
    sinks.stage_report(rows.limit(1), rows.limit(1), rows, rows.limit(0), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s/results")).count() == 10


def test_streams(spark, tmp_path):
    schema = "chunk_id string, filing_date string, text string"
    for batch in [[("a", "20240101", "old"), ("b", "20240101", "b")], [("a", "20240201", "new")]]:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.upsert(stream.file_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(60)
        got = {r.chunk_id: r.text for r in stream.current(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": "new", "b": "b"}
    events = spark.createDataFrame([("2024-01-01 00:05:00", "x", 1, 2.0), ("2024-01-01 00:55:00", "x", 1, 3.0), ("2024-01-01 01:05:00", "x", 1, 4.0)], "t string, event_type string, user_id int, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r.total for r in stream.tumbling(events).collect()) == [4.0, 5.0]
    assert sorted(r.n for r in stream.sessions(events).collect()) == [1, 2]


def test_late_rows_do_not_win(spark, tmp_path):
    schema = "chunk_id string, filing_date string, text string"
    batches = [[("a", "20240201", "new"), ("b", "20240101", "b")], [("a", "20240101", "late"), ("c", None, "c")], [("b", "20240101", "same date, later batch"), ("c", "20240101", "dated")]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.upsert(stream.file_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp"), buckets=4).awaitTermination(60)
    got = {r.chunk_id: r.text for r in stream.current(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": "new", "b": "same date, later batch", "c": "dated"}
    assert all(len(v) <= 2 for v in stream._versions(spark, str(tmp_path / "out")).values())


def test_files_meet_by_key(spark, tmp_path):
    write_corpus(tmp_path)
    raw, manifest = files.raw_files(spark, str(tmp_path)), files.manifest(spark, str(tmp_path / "manifest.jsonl"))
    met = files.main_files(raw, manifest)
    assert met.count() == 4 and met.where("is_main").count() == 4
    plan = met._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    asked = spark.createDataFrame([("raw/periodic/회사/x",), ("raw/none/a",), ("raw/periodic",)], "path string")
    listed = spark.createDataFrame([(unicodedata.normalize("NFD", "raw/periodic/회사/y"),), ("raw/major/z",)], "path string")
    why = {r.path: (r.failed_at, r.failed_part, r.siblings) for r in files.unresolved(asked, listed).collect()}
    assert why == {"raw/periodic/회사/x": (3, "x", ["y"]), "raw/none/a": (1, "none", ["major", "periodic"])}


def test_http_chat():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            message = {"role": "assistant", "content": "", "toolCalls": [{"id": "c1", "type": "function", "function": {"name": "f", "arguments": {"a": 1}}}]} if len(seen) == 2 else {"role": "assistant", "content": "답"}
            status = "50000" if len(seen) == 1 else "20000"
            body = json.dumps({"status": {"code": status}, "result": {"message": message}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = chat.HttpChat(f"http://127.0.0.1:{server.server_port}/", "k", max_tokens=5, thinking={"effort": "none"})
    retrying = tools.Retrying(client, sleep=lambda s: None)
    assert retrying.chat([{"role": "user", "content": "q"}], [{"name": "f"}]) == {"text": None, "calls": [{"id": "c1", "name": "f", "arguments": {"a": 1}}]}
    history = [{"role": "assistant", "content": "", "calls": [{"id": "c1", "name": "f", "arguments": {"a": 1}}]}, {"role": "tool", "tool_call_id": "c1", "name": "f", "content": "{}"}]
    assert client.chat(history, []) == {"text": "답"}
    server.shutdown()
    assert seen[0] == seen[1] and seen[0][0] == "Bearer k" and "maxTokens" not in seen[0][1] and seen[0][1]["thinking"] == {"effort": "none"}
    assert seen[2][1]["maxTokens"] == 5 and seen[2][1]["messages"][0]["toolCalls"][0]["function"]["name"] == "f" and seen[2][1]["messages"][1]["toolCallId"] == "c1"


def test_model_router():
    class Client:
        def __init__(self, reply):
            self.reply = reply

        def chat(self, messages, schemas):
            assert schemas[0]["parameters"]["properties"]["route"]["enum"][-1] == "unclear" and messages[1]["content"] == "q"
            return self.reply

    call = lambda route: {"calls": [{"id": "1", "name": "classify_route", "arguments": {"route": route}}]}
    answers = [routing.model_route(Client(r), "q") for r in (call("calculation"), call("unclear"), call("nonsense"), {"text": "hm"})]
    assert answers == ["calculation", None, None, None]


def test_entities_with_a_model(spark):
    rows = spark.createDataFrame([("현대차 매출액", '{"companies": ["x"], "metrics": ["영업이익"], "explicit_correction": true}'), ("그 회사", '{"companies": ["다른회사"], "period": ["2024"]}'), ("그 회사", "no json"), ("그 회사", None)], "query string, said string")
    out = [r.entities for r in entities.with_model(entities.extract(rows, [("현대차", "현대자동차")], ["매출액"]), F.col("said")).collect()]
    assert out[0].companies == ["현대자동차"] and out[0].metrics == ["매출액"] and out[0].explicit_correction is False
    assert out[1].companies == ["다른회사"] and out[1].company_count == 1 and out[1].period == ["2024"] and out[2].companies == [] == out[3].companies


def test_ask(spark):
    class Client:
        def chat(self, messages, schemas):
            if len(messages) == 2:
                return {"calls": [{"name": "search_disclosures", "arguments": {"query": "매출액"}}]}
            return {"text": "done"}

    item = {"chunk_id": "c1", "report_id": "r1", "company": "A", "report_name": "n", "filing_date": "d", "section_path": ["s"], "is_correction": False, "is_latest": True, "text": "매출액 1,234억", "period": "2024"}
    registry = tools.Registry([tools.Tool("search_disclosures", "", {}, lambda query: {"results": [item]})])
    replies = iter(["9,999,999", "1,234억 (r1)"])
    out = ask.ask(spark, "현대차 매출액?", Client(), registry, [("현대차", "현대자동차")], ["매출액"], lambda pack, warnings: next(replies), lambda q: "single_lookup")
    assert out.normalized == "[COMPANY] 매출액?" and out.retries == 1 and out.validation["passed"]
    none = ask.ask(spark, "x", Client(), tools.Registry([tools.Tool("search_disclosures", "", {}, lambda query: {"results": []})]), [], [], lambda p, w: "never")
    assert none.answer == tools.NO_EVIDENCE
