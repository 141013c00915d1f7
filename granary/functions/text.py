"""Text functions: columns in, columns out.  Pandas UDFs only where Spark has no function."""

from __future__ import annotations

import json
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

#: Blanks as Python's ``str.split`` knows them: ``\\s`` with Unicode, and the separators U+001C to U+001F.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Normal form C; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(BooleanType())
def is_nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t is None or unicodedata.is_normalized("NFC", t))


def whitespace_tokens(text: Column | str) -> Column:
    return F.array_remove(F.split(F.coalesce(col(text), F.lit("")), BLANKS), "")


def char_ngrams(text: Column | str, n: int) -> Column:
    """All n-grams of the text without blanks; a shorter text is one token, an empty one none.

    The text's characters are an array whose shifted slices are joined, so the work grows with the text's length.
    """
    bare = F.regexp_replace(F.coalesce(col(text), F.lit("")), BLANKS, "")

    def grams(chars: Column) -> Column:
        most = F.greatest(F.size(chars) - (n - 1), F.lit(0))
        out = F.slice(chars, 1, most)
        for k in range(1, n):
            out = F.zip_with(out, F.slice(chars, k + 1, most), lambda a, b: F.concat(a, b))
        return F.when(most == 0, F.array(F.array_join(chars, ""))).otherwise(out)

    # The characters are an element of an array, so that they are made once for all slices.
    whole = F.transform(F.array(F.split(bare, "")), grams)[0]
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(whole)


def ngram_size(name: str) -> int | None:
    """The n of ``char_{n}gram``."""
    return int(name[5:-4]) if name.startswith("char_") and name.endswith("gram") and name[5:-4].isdigit() else None


def tokenizer(name: str):
    """``whitespace`` or ``char_{n}gram``; a morphological analyser is a model of its own and has to be given as a function of a column."""
    if name == "whitespace":
        return whitespace_tokens
    n = ngram_size(name)
    if n is not None:
        return lambda text: char_ngrams(text, n)
    raise ValueError(f"unknown tokenizer {name!r}")


def estimate_tokens(text: Column | str) -> Column:
    """Half a token a character, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 2)).cast("int")


# fixed values: numbers, restatements that don't count, and document ids
NUMBER = r"(\d[\d,]*\.?\d*)"
RESTATEMENT = r"\(약[^)]*\)"
DOC_ID = r"(\b(?:periodic|major|exchange|holding)_\d{10,}\b)"


def numbers(text: Column | str, min_digits: int = 3) -> Column:
    """Distinct numbers without commas, of ``min_digits`` digits at least; parts around a point count too.  Restatements "(약 ...)" don't."""
    plain = F.regexp_replace(F.coalesce(col(text), F.lit("")), RESTATEMENT, " ")
    found = F.transform(F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    whole = F.filter(found, lambda x: F.length(F.replace(x, F.lit("."), F.lit(""))) >= min_digits)
    parts = F.filter(F.flatten(F.transform(F.filter(found, lambda x: F.instr(x, ".") > 0), lambda x: F.split(x, r"\."))), lambda x: F.length(x) >= min_digits)
    return F.array_sort(F.array_distinct(F.concat(whole, parts)))


def doc_ids(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(DOC_ID), F.lit(1))


def periods(text: Column | str) -> Column:
    """Periods in the order of the text; of alternatives at a place the first listed counts."""
    # fixed values: recent years, year and month, year, quarter, half
    pattern = r"(최근\s*\d+\s*년|20\d{2}[.\-]\s*\d{1,2}\s*월?|20\d{2}\s*년?|[1-4]\s*분기|상반기|하반기)"
    return F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(pattern), F.lit(1)), lambda x: F.trim(x))


# fixed values: characters that titles are compared without, prefixes of corrected titles, and keywords
TITLE_NOISE = "ㆍ· /[]()"
CORRECTION_PREFIXES = ("[기재정정]", "[첨부추가]")
CORRECTION_KEYWORDS = ("기재정정", "정정공시", "정정")
REPORT_NAMES = ("사업보고서", "반기보고서", "분기보고서", "주요사항보고서", "주식등의대량보유상황보고서", "대량보유상황보고서", "감사보고서", "연결감사보고서")


def bare_title(text: Column | str) -> Column:
    return F.translate(col(text), TITLE_NOISE, "")


def title_match(needle: Column, *titles: Column | str) -> Column:
    """Whether the bare needle is within a bare title; null titles never match."""
    hits = [F.coalesce(F.contains(bare_title(t), bare_title(needle)), F.lit(False)) for t in titles]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def strip_correction_prefix(title: Column | str) -> Column:
    out = col(title)
    for prefix in CORRECTION_PREFIXES:
        out = F.replace(out, F.lit(prefix), F.lit(""))
    return F.trim(out)


def mentions_correction(text: Column | str) -> Column:
    return F.coalesce(col(text).rlike("|".join(CORRECTION_KEYWORDS)), F.lit(False))


def report_name(text: Column | str) -> Column:
    """The first report name, in the order of the list, that the text contains."""
    return F.coalesce(*[F.when(F.contains(col(text), F.lit(t)), F.lit(t)) for t in REPORT_NAMES])


def metrics(text: Column | str, terms: list[str]) -> Column:
    """Terms that the text contains, case apart, in the order of the list."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, F.lower(t)))


def clean_lines(text: Column | str) -> Column:
    """Lines without numbering and bullets; empty ones are dropped."""
    lines = F.transform(F.split(F.coalesce(col(text), F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:\d+[.)]|[-*•])\s*", "")))
    return F.filter(lines, lambda x: x != "")


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel over the shorter text)."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def sorted_token_ratio(a: str | None, b: str | None) -> float:
    """Indel similarity (0 to 100) of the texts with their tokens sorted; null is an empty text."""
    a, b = (" ".join(sorted((x or "").split())) for x in (a, b))
    return 100.0 if not a and not b else 200.0 * _common(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sorted_token_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(StringType())
def canonical_key(name: pd.Series, arguments: pd.Series) -> pd.Series:
    """``name::json`` with sorted keys, by which equal tool calls are told."""
    return pd.Series([f"{n}::{json.dumps(json.loads(a or '{}'), sort_keys=True, ensure_ascii=False)}" for n, a in zip(name, arguments, strict=True)])


@F.pandas_udf(StringType())
def point_id(chunk_id: pd.Series) -> pd.Series:
    """A stable UUID of a chunk's id, as vector stores want it."""
    return chunk_id.map(lambda c: None if c is None else str(uuid.uuid5(uuid.NAMESPACE_URL, c)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null if either vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, i: s + i)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
