"""Which filing supersedes which: version groups, their order, and the latest of each."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.storage import cut

#: Score from which a title decides between several candidates.
FUZZY_LEAST = 40.0
BY_DATE = ("rcept_dt", "rcept_no")

# fixed values: how a correction names the filing it corrects, as most groups write it and as exchange filings do
_DATE = r"(\d{4})\s*[-.년]\s*(\d{1,2})\s*[-.월]\s*(\d{1,2})\s*일?"
TARGET_DATES = (r"정정대상\s*공시서류의\s*최초제출일\s*[:：]?\s*" + _DATE, r"정정관련\s*공시서류제출일\s*[:：]?\s*" + _DATE)
TARGET_TITLES = (r"정정대상\s*공시서류\s*[:：]?\s*(.+?)\s*(?=\d\s*\.\s*정정)", r"정정관련\s*공시서류\s*[:：]?\s*(.+?)\s*(?=\d\s*\.\s*정정)")


def flat(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def correction_target(text: Column, doc_group: Column) -> Column:
    """``target_date`` (YYYYMMDD, not checked against the calendar), ``target_title``, ``ok``: from a correction's flat text.

    Exchange filings use the second wording; each group falls back on the other's.
    """

    def date(pattern: str) -> Column:
        numbers = F.regexp_extract_all(F.regexp_extract(text, pattern, 0), F.lit(r"\d+"), F.lit(0))  # all that a match has are the date's
        joined = lambda n: F.when(F.size(n) == 3, F.concat(n[0], F.lpad(n[1], 2, "0"), F.lpad(n[2], 2, "0")))
        return F.transform(F.array(numbers), joined)[0]  # an element, so that the text is searched once

    def title(pattern: str) -> Column:
        found = F.regexp_extract(text, pattern, 1)
        return F.when(found != "", F.trim(found))

    exchange = doc_group.eqNullSafe("exchange")
    pick = lambda f, patterns: F.when(exchange, F.coalesce(f(patterns[1]), f(patterns[0]))).otherwise(F.coalesce(f(patterns[0]), f(patterns[1])))
    found = pick(date, TARGET_DATES)
    return F.struct(found.alias("target_date"), pick(title, TARGET_TITLES).alias("target_title"), found.isNotNull().alias("ok"))


def finalize(rows: DataFrame, group: str | list[str] = "correction_group_id", order: tuple[str, ...] = BY_DATE) -> DataFrame:
    """``correction_order`` from 0 by date within the group, and ``is_latest`` for the last."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("correction_order", F.row_number().over(w) - 1).withColumn("is_latest", F.lead(F.lit(1)).over(w).isNull())


def keyed_groups(rows: DataFrame, keys: list[str], doc_id: str = "doc_id", order: tuple[str, ...] = BY_DATE) -> DataFrame:
    """Groups of equal keys (nulls are equal), named by their earliest document."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return finalize(rows.withColumn("correction_group_id", F.first(doc_id).over(w)).withColumn("resolution_source", F.lit("manifest_key")), keys, order)


def _linked(rows: DataFrame, candidate_keys: list[str], score: Column | None = None) -> DataFrame:
    """``rows`` with what ``parents`` finds.

    A filing meets its candidates' number and their first and last id, which settles those with one; titles are compared only for those with several.
    """
    asks = F.col("is_correction") & (F.col("file_format") == "xml")
    keys = {f"_key{i}": F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for i, k in enumerate(candidate_keys)}  # nulls are equal
    place = ["_hash", "_date", *keys]  # the hash goes first: rows are sorted by it

    def placed(df: DataFrame, date: Column) -> DataFrame:
        return df.withColumns({"_date": date, **keys}).withColumn("_hash", F.when(F.col("_date").isNotNull(), F.xxhash64("_date", *keys)))

    theirs = placed(rows, F.col("rcept_dt")).where("_date is not null")
    counted = theirs.groupBy(*place).agg(F.count("doc_id").alias("_all"), F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    met = placed(rows, F.when(asks, F.col("target_date"))).join(counted, place, "left")
    # a filing is among its own candidates where it names its own date
    met = met.withColumn("n", F.coalesce("_all", F.lit(0)) - F.coalesce(F.col("_date") == F.col("rcept_dt"), F.lit(False)).cast("int"))
    other = F.when(F.col("_first") == F.col("doc_id"), F.col("_last")).otherwise(F.col("_first"))
    met = cut(met.withColumn("only", F.when(F.col("n") == 1, other)).select(*rows.columns, *place, "n", "only"))

    candidates = theirs.select(*place, F.col("doc_id").alias("c_id"), F.col("rcept_no").alias("c_no"), F.col("report_nm").alias("c_title"))
    several = met.where("n > 1").join(candidates, place).where("doc_id <> c_id")
    like = score if score is not None else T.token_sort_ratio(F.col("target_title"), T.strip_correction_prefix("c_title"))
    several = several.withColumn("like", like)
    best = several.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("like"), "c_no", "c_id"))).where("i = 1")
    chosen = best.where(F.col("like") >= FUZZY_LEAST).select("doc_id", F.col("c_id").alias("chosen"))
    source = (
        F.when(~F.col("is_correction"), "original")
        .when(F.col("file_format") != "xml", "unsupported_format")
        .when(F.col("target_date").isNull() | F.col("parent").isNull(), "unresolved")
        .when(F.col("n") > 1, "fuzzy_tiebreak")
        .when(F.col("overridden"), "manual_override")
        .otherwise("rule")
    )
    return met.join(chosen, "doc_id", "left").withColumn("parent", F.coalesce("only", "chosen")).select(*rows.columns, "parent", source.alias("resolution_source"))


def parents(rows: DataFrame, candidate_keys: list[str], score: Column | None = None) -> DataFrame:
    """``doc_id, parent, resolution_source``: the filing that each correction names by date.

    Of several candidates the one whose title is most like the named title is taken, if its score reaches
    FUZZY_LEAST; ties go to the earlier and then smaller document.
    """
    return _linked(rows, candidate_keys, score).select("doc_id", "parent", "resolution_source")


def roots(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``doc_id, root`` from ``doc_id, parent``, by pointer doubling: rounds grow with the logarithm of the longest chain.

    A round takes only what hasn't reached its root.  A document in a cycle is its own root; one that leads into a cycle
    has the cycle's first document it meets.
    """
    up = F.coalesce("parent", "doc_id")
    own = cut(links.select("doc_id", up.alias("up"), (up == F.col("doc_id")).alias("done")))
    settled, rest, before = own.where("done"), own.where("not done"), None
    for _ in range(most_rounds):
        unsettled = rest.count()
        if unsettled in (0, before):  # what no longer shrinks is in or before a cycle
            break
        above = settled.unionByName(rest).select(F.col("doc_id").alias("at"), F.col("up").alias("above"), F.col("done").alias("ends"))
        now = cut(rest.select("doc_id", F.col("up").alias("at")).join(above, "at").select("doc_id", F.col("above").alias("up"), F.col("ends").alias("done")))
        settled, rest, before = settled.unionByName(now.where("done")), now.where("not done"), unsettled
    out = settled.select("doc_id", F.col("up").alias("root"))
    if not unsettled:
        return out
    return out.unionByName(_with_cycles(own.select("doc_id", "up").join(rest.select("doc_id"), "doc_id", "left_semi")))


def _with_cycles(own: DataFrame) -> DataFrame:
    """Follows the few chains that end in a cycle step by step, each with the path it has seen."""
    walk = own.select("doc_id", F.col("up").alias("at"), F.array("doc_id").alias("seen"))
    done = None
    up = own.select(F.col("doc_id").alias("at"), F.col("up").alias("next"))
    while True:
        ended = F.array_contains("seen", F.col("at"))
        got = walk.where(ended).select("doc_id", F.col("at").alias("root"))
        done = got if done is None else done.unionByName(got)
        walk = walk.where(~ended).withColumn("seen", F.array_append("seen", F.col("at"))).join(up, "at").select("doc_id", F.col("next").alias("at"), "seen")
        walk = cut(walk)
        if walk.isEmpty():
            return done


def event_groups(rows: DataFrame, candidate_keys: list[str]) -> DataFrame:
    """Groups along the chain of corrections; unresolved corrections are groups of their own."""
    links = cut(_linked(rows, candidate_keys))
    grouped = links.drop("parent").join(roots(links.select("doc_id", "parent")).withColumnRenamed("root", "correction_group_id"), "doc_id")
    return finalize(grouped)


def correction_index(manifest: DataFrame, texts: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``doc_id, correction_group_id, correction_order, is_correction, is_latest, resolution_source`` for all filings.

    ``texts`` has the ``doc_id, text`` of main files; ``overrides`` a ``doc_id, target_date`` that beats what the text says.
    """
    found = texts.select("doc_id", flat(F.col("text")).alias("flat"))
    rows = manifest.join(found, "doc_id", "left")
    rows = rows.join(overrides.withColumnRenamed("target_date", "fixed_date"), "doc_id", "left") if overrides is not None else rows.withColumn("fixed_date", F.lit(None).cast("string"))
    asked = F.when(F.col("is_correction") & (F.col("doc_group") != "periodic"), F.col("flat"))
    target = correction_target(asked, F.col("doc_group"))
    rows = rows.withColumn("_t", target).withColumn("overridden", F.col("fixed_date").isNotNull())
    rows = rows.withColumn("target_date", F.coalesce("fixed_date", "_t.target_date")).withColumn("target_title", F.when(~F.col("overridden"), F.col("_t.target_title")))
    held = ["doc_id", "doc_group", "corp_name", "flr_nm", "doc_subtype", "base_year", "base_month", "report_nm", "rcept_dt", "rcept_no", "is_correction", "file_format", "overridden", "target_date", "target_title"]
    rows = cut(rows.select(held))  # texts are read once for all groups
    columns = ["doc_id", "correction_group_id", "correction_order", "is_correction", "is_latest", "resolution_source"]
    periodic = keyed_groups(rows.where("doc_group = 'periodic'"), ["corp_name", "doc_subtype", "base_year", "base_month"])
    events = rows.where(F.col("doc_group").isin("major", "exchange", "holding")).withColumn("_filer", F.when(F.col("doc_group") == "holding", F.col("flr_nm")))
    events = events.drop("flr_nm", "doc_subtype", "base_year", "base_month")
    return periodic.select(columns).unionByName(event_groups(events, ["doc_group", "corp_name", "_filer"]).select(columns))


def of_company(filings: DataFrame, company: str, title: str | None = None) -> DataFrame:
    """A company's filings (its name in normal form C), those of matching titles if one is given."""
    rows = filings.where(F.col("corp_name") == unicodedata.normalize("NFC", company))
    return rows.where(T.title_match(F.lit(title), "report_nm", "doc_subtype")) if title else rows


def version_groups(filings: DataFrame) -> DataFrame:
    """Each version group as one row: ``correction_group_id, n_versions, corrected, versions`` (in order).  A group is as long as a filing has versions."""
    version = F.struct("correction_order", "doc_id", "report_nm", "rcept_dt", "is_correction", "is_latest", "resolution_source")
    grouped = filings.groupBy("correction_group_id").agg(F.array_sort(F.collect_list(version), lambda a, b: a["correction_order"] - b["correction_order"]).alias("versions"), F.bool_or("is_correction").alias("corrected"))
    return grouped.select("correction_group_id", F.size("versions").alias("n_versions"), "corrected", "versions")


def correction_history(filings: DataFrame, company: str, title: str | None = None, corrected_only: bool = False) -> DataFrame:
    """The version groups of a company (of matching titles); with ``corrected_only`` those that hold a correction."""
    groups = version_groups(of_company(filings, company, title))
    return (groups.where("corrected") if corrected_only else groups).drop("corrected")


def latest_report(filings: DataFrame, keys: list[str], order: tuple[str, ...] = BY_DATE) -> DataFrame:
    """The last valid filing of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return filings.where("is_latest").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
