"""Text, calculation and entity functions on small rows."""

import pytest
from pyspark.sql import functions as F

from granary.functions import calc, entities
from granary.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.whitespace_tokens("t"), t=" a　b\x1cc \n") == ["a", "b", "c"]
    assert one(spark, T.whitespace_tokens("t"), t="") == []
    assert one(spark, T.char_ngrams("t", 2), t="매출 액") == ["매출", "출액"]
    assert one(spark, T.char_ngrams("t", 3), t="ab") == ["ab"]
    assert one(spark, T.char_ngrams("t", 3), t=" ") == []
    with pytest.raises(ValueError):
        T.tokenizer("nothing")


def test_nfc(spark):
    import unicodedata

    nfd = unicodedata.normalize("NFD", "현대자동차")
    assert one(spark, T.nfc("t"), t=nfd) == "현대자동차"
    assert one(spark, T.is_nfc("t"), t=nfd) is False


def test_numbers(spark):
    assert one(spark, T.numbers("t"), t="7,661,584백만원 (약 7조 6,615억원) 12 and 2023.12") == ["2023", "2023.12", "7661584"]
    assert one(spark, T.doc_ids("t"), t="see major_20250828001452, x") == ["major_20250828001452"]


def test_periods_and_names(spark):
    assert one(spark, T.periods("t"), t="최근 3년, 2024년 3분기와 2023.12 상반기") == ["최근 3년", "2024년", "3분기", "2023.12", "상반기"]
    assert one(spark, T.report_name("t"), t="연결감사보고서") == "감사보고서"
    assert one(spark, T.metrics("t", ["매출액", "매출", "ROE"]), t="매출액과 roe") == ["매출액", "매출", "ROE"]
    assert one(spark, T.mentions_correction("t"), t="정정됐어?") is True
    assert one(spark, T.title_match(F.col("t"), F.lit("[기재정정]단일판매ㆍ공급계약체결")), t="단일판매 공급계약체결") is True


def test_token_sort_ratio(spark):
    assert one(spark, T.token_sort_ratio(F.lit("b a"), F.lit("a b"))) == 100.0
    assert one(spark, T.token_sort_ratio(F.lit(None).cast("string"), F.lit("a b"))) == 0.0
    assert abs(one(spark, T.token_sort_ratio(F.lit("kitten"), F.lit("sitting"))) - 200 * 4 / 13) < 1e-9


def test_calculations(spark):
    number = F.lit
    assert one(spark, calc.growth_rate(number(100.0), number(150.0))).value == 50.0
    assert one(spark, calc.growth_rate(number(-100.0), number(150.0))).value == 250.0
    assert one(spark, calc.growth_rate(number(0.0), number(1.0))).error
    assert one(spark, calc.ratio(number(50.0), number(200.0))).percent == 25.0
    assert one(spark, calc.ratio(number(1.0), number(0.0))).error
    assert 25.0 < one(spark, calc.cagr(number(1.0), number(2.0), number(3.0))).value < 26.5
    assert one(spark, calc.cagr(number(1.0), number(-2.0), number(3.0))).error


TABLE = [("현대자동차", "현대자동차"), ("현대차", "현대자동차"), ("KT", "케이티"), ("케이티", "케이티"), ("현대", "현대그룹")]


def test_entities(spark):
    rows = spark.createDataFrame([(1, "현대차와 KT의 2024년 매출액 비교"), (2, "현대차 현대차"), (3, "KT 배당"), (4, "none")], "query_id int, query string")
    out = {r.query_id: r for r in entities.extract(rows, TABLE, ["매출액"]).withColumn("n", entities.normalized(F.col("query"), F.col("entities.company_spans"))).collect()}
    assert out[1].entities.companies == ["현대자동차", "케이티"] and out[1].n == "[COMPANY_1]와 [COMPANY_2]의 2024년 매출액 비교"
    assert out[2].n == "[COMPANY_1] [COMPANY_1]" and out[2].entities.company_count == 1
    assert out[3].n == "[COMPANY] 배당" and out[4].n == "none" and out[1].entities.metrics == ["매출액"]
