"""The catalog as NDJSON, out and in, and the doctor that puts it in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.functions import constants as K
from jobloom.functions import identity
from jobloom.operators.gate import posting_path

RECORD = (
    "companyKey string, atsProvider string, name string, displayDomain string, website string, firstSeen string, lastSeen string, "
    "careerPages array<struct<url:string,firstSeen:string,lastSeen:string>>, broken string"
)


def _utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def export_lines(companies: DataFrame, pages: DataFrame) -> DataFrame:
    """(company_key, line): each company as JSON with its pages in order of URL; names, domains
    and websites that are empty are left out. Pages of no company are dropped.

    companies: company_key, ats_provider, name, display_domain, website, first_seen, last_seen;
    pages: company_key, url, first_seen, last_seen."""
    page = F.struct("url", _utc(F.col("first_seen")).alias("firstSeen"), _utc(F.col("last_seen")).alias("lastSeen"))
    theirs = pages.groupBy("company_key").agg(F.sort_array(F.collect_list(page)).alias("careerPages"))
    given = lambda c, name: F.nullif(F.col(c), F.lit("")).alias(name)
    none = F.array().cast("array<struct<url:string,firstSeen:string,lastSeen:string>>")
    record = F.struct(
        F.col("company_key").alias("companyKey"), F.coalesce("ats_provider", F.lit("")).alias("atsProvider"), given("name", "name"), given("display_domain", "displayDomain"),
        given("website", "website"), _utc(F.col("first_seen")).alias("firstSeen"), _utc(F.col("last_seen")).alias("lastSeen"), F.coalesce("careerPages", none).alias("careerPages"))
    return companies.join(theirs, "company_key", "left").select("company_key", F.to_json(record).alias("line"))


def write_export(lines: DataFrame, path: str) -> None:
    """The lines as text files in order of their keys: range-partitioned, so not one task's work."""
    lines.orderBy("company_key").select("line").write.mode("overwrite").text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw) of text files, lines counted from 1 in each file, blank ones too. Blocks are
    counted first; the window runs over one row per block."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))
    blocks = text.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", "first", F.coalesce(earlier, F.lit(0)).alias("before"))
    return text.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "raw")


def _says(error: str, value: Column) -> Column:
    return F.replace(F.lit(K.IMPORT_ERRORS[error]), F.lit("@"), value)


def _http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#\s]+"), F.lit(False))


def resolve_import(lines: DataFrame) -> DataFrame:
    """Each non-blank row of ``lines`` (line, raw) as a company or an error.

    Returns line, error (null if it lands), company struct, pages array, page_errors array.
    The key is the given one, else the website's registrable domain, else the one identity
    of all pages. A page that is no absolute http(s) URL is an error of its own beside a
    company that lands, unless the key would hang on it. Malformed times count as absent."""
    rows = lines.filter(F.trim(F.col("raw"), F.lit(" \t\r\n")) != "")
    rows = rows.select("line", F.from_json("raw", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("r"))
    all_pages = F.coalesce("r.careerPages", F.array().cast("array<struct<url:string,firstSeen:string,lastSeen:string>>"))
    rows = rows.withColumn("good", F.filter(all_pages, lambda p: _http(p["url"]))).withColumn("bad", F.filter(all_pages, lambda p: ~_http(p["url"])))
    site = F.nullif(F.col("r.website"), F.lit(""))
    domain = F.when(site.isNotNull(), identity.registrable_domain(identity.hostname(site)))
    keys = F.array_sort(F.array_distinct(F.transform("good", lambda p: identity.identify(p["url"])["company_key"])))
    rows = rows.withColumn("keys", keys).withColumn("domain", domain).withColumn("given", F.nullif(F.col("r.companyKey"), F.lit("")))
    by_pages = F.col("given").isNull() & F.col("domain").isNull()
    page_error = lambda p: _says("page", F.coalesce(p["url"], F.lit("")))
    error = (
        F.when(F.col("r").isNull() | F.col("r.broken").isNotNull(), K.IMPORT_ERRORS["json"])
        .when(site.isNotNull() & ~_http(site), _says("website", site))
        .when(by_pages & (F.size("good") + F.size("bad") == 0), K.IMPORT_ERRORS["nobody"])
        .when(by_pages & (F.size("bad") > 0), page_error(F.get("bad", 0)))
        .when(by_pages & (F.size("keys") > 1), _says("many", F.array_join("keys", ", ")))
    )
    key = F.coalesce("given", "domain", F.get("keys", 0))
    on_board = F.contains(key, F.lit(":"))
    or_default = lambda c, d: F.coalesce(F.col("r." + c), d).alias
    when = lambda c: F.try_to_timestamp(c)
    company = F.struct(
        key.alias("company_key"), or_default("atsProvider", F.when(on_board, F.substring_index(key, ":", 1)).otherwise(""))("ats_provider"),
        or_default("name", F.when(on_board, F.regexp_replace(key, "^[^:]*:", "")).otherwise(key))("name"),
        or_default("displayDomain", F.coalesce("domain", F.when(on_board, "").otherwise(key)))("display_domain"), or_default("website", F.lit(""))("website"),
        when(F.col("r.firstSeen")).alias("first_seen"), when(F.col("r.lastSeen")).alias("last_seen"))
    page = lambda p: F.struct(identity.stored_page_url(p["url"]).alias("url"), identity.hostname(p["url"]).alias("politeness_domain"), when(p["firstSeen"]).alias("first_seen"), when(p["lastSeen"]).alias("last_seen"))
    rows = rows.withColumn("error", error)
    lands = F.col("error").isNull()
    return rows.select("line", "error", F.when(lands, company).alias("company"), F.when(lands, F.transform("good", page)).alias("pages"), F.when(lands, F.transform("bad", page_error)).alias("page_errors"))


def import_report(resolved: DataFrame) -> DataFrame:
    """companies and pages that land, and the count of errors."""
    return resolved.agg(
        F.count_if(F.col("error").isNull()).alias("companies"), F.coalesce(F.sum(F.size("pages")), F.lit(0)).cast("long").alias("pages"),
        (F.count_if(F.col("error").isNotNull()) + F.coalesce(F.sum(F.size("page_errors")), F.lit(0))).cast("long").alias("errors"))


def import_errors(resolved: DataFrame, reported: int = K.IMPORT_ERRORS_REPORTED) -> DataFrame:
    """The first errors (line, message) in order of lines."""
    every = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.col("page_errors"))
    return resolved.select("line", F.posexplode(every).alias("at", "message")).orderBy("line", "at").limit(reported).select("line", "message")


def doctor_plan(pages: DataFrame, companies: DataFrame) -> DataFrame:
    """What is to become of each row of ``pages`` (page_id, url, company_key).

    Returns page_id, action (keep, delete, reattribute, merge), company_key (the owner it
    should have) and merge_into. Pages of aggregators and single postings go; those that
    come to the same company and page identity are merged into one: first one that its
    company owns and that is written as its identity, then owned, then so written, then
    any; ties by page_id. Survivors come from an aggregation, so a large group is
    reduced before it is shuffled."""
    url = F.col("url")
    known = pages.join(companies.select("company_key", F.lit(True).alias("owner")), "company_key", "left")
    known = identity.with_once(known, b_=identity.board(url))
    known = identity.with_once(known, kind_=identity.role(url, F.col("b_")), key_=identity.identify(url, F.col("b_"))["company_key"], final_=identity.stored_page_url(url, F.col("b_")))
    kind = F.col("kind_")
    gone = identity.is_aggregator(url) | (kind == "job_listing") | ((kind == "unknown") & posting_path(url))
    parsed = identity.with_once(known, is_url=F.coalesce(identity.hostname(url) != "", F.lit(False)), gone=F.coalesce(gone, F.lit(False))).select(
        "page_id", "url", F.when(F.col("owner"), F.col("company_key")).alias("owned_by"), F.col("company_key").alias("old_key"), "is_url", "gone", F.col("key_").alias("key"), F.col("final_").alias("final"))
    decided = parsed.filter(~F.col("is_url") | F.col("gone"))
    decided = decided.select("page_id", F.when(F.col("is_url"), "delete").otherwise("keep").alias("action"), F.col("old_key").alias("company_key"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("merge_into"))
    left = parsed.filter("is_url AND NOT gone")
    owned, written = F.coalesce(F.col("owned_by") == F.col("key"), F.lit(False)), F.col("url") == F.col("final")
    rank = F.when(owned & written, 0).when(owned, 1).when(written, 2).otherwise(3)
    best = left.groupBy("key", "final").agg(F.min(F.struct(rank.alias("rank"), "page_id"))["page_id"].alias("best"))
    own = F.when(owned, "keep").otherwise("reattribute")
    grouped = left.join(best, ["key", "final"]).select(
        "page_id", F.when(F.col("page_id") == F.col("best"), own).otherwise("merge").alias("action"), F.col("key").alias("company_key"), F.when(F.col("page_id") != F.col("best"), F.col("best")).alias("merge_into"))
    return decided.unionByName(grouped)


def orphan_companies(plan: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies that no page belongs to after the plan."""
    owners = plan.filter(F.col("action").isin("keep", "reattribute")).select("company_key")
    return companies.join(owners, "company_key", "left_anti")


def apply_plan(plan: DataFrame, pages: DataFrame, companies: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, companies, listings) after the plan. Listings (.., career_page_id) of deleted pages
    go, those of merged ones move; nothing else about them changes. Planning the result
    again keeps everything."""
    stay = plan.filter(F.col("action").isin("keep", "reattribute")).select("page_id", F.col("company_key").alias("new_key"), "action")
    new_pages = pages.join(stay, "page_id").withColumn("company_key", F.col("new_key")).select(pages.columns)
    left = companies.join(stay.select(F.col("new_key").alias("company_key")), "company_key", "left_semi")
    fresh = stay.filter("action = 'reattribute'").select(F.col("new_key").alias("company_key")).distinct().join(companies, "company_key", "left_anti")
    moved = plan.select(F.col("page_id").alias("career_page_id"), F.col("action").alias("plan_"), "merge_into")
    kept = listings.join(moved, "career_page_id", "left").filter("plan_ IS NULL OR plan_ <> 'delete'")
    kept = kept.withColumn("career_page_id", F.coalesce("merge_into", "career_page_id")).select(listings.columns)
    return new_pages, left.unionByName(fresh, allowMissingColumns=True), kept
