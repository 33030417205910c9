"""Job-board feeds: JSON and XML payloads to listing rows, as Column expressions.

Payloads are rows (tenant, payload): one response of one board each; boards that answer in pages
have several. Each mapper returns tenant, source_id, url, title, location, country_hint,
department, work_arrangement, body, published; rows without a URL are left out, text that is absent is
empty. A board is complete if all that it announces has been read (:func:`boards`); only then may
listings that it does not hold be closed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.markup import encoded_once, encoded_twice
from jobloom.functions.text import work_arrangement

COLUMNS = ["source_id", "url", "title", "location", "country_hint", "department", "work_arrangement", "body", "published"]


def _filled(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _rows(payloads: DataFrame, schema: str, items: str, fields: dict[str, Column], xml: bool = False) -> DataFrame:
    parsed = F.from_xml("payload", schema) if xml else F.from_json("payload", schema)
    return _listings(payloads.select("tenant", parsed.alias("p")).select("tenant", F.explode("p" + ("." + items if items else "")).alias("j")), fields)


def _listings(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    fields = {"country_hint": F.lit(""), "work_arrangement": F.lit("unspecified"), "published": F.lit(None), **fields}
    out = rows.select("tenant", *[fields[n].cast("timestamp").alias(n) if n == "published" else F.coalesce(fields[n].cast("string"), F.lit("")).alias(n) for n in COLUMNS])
    return out.filter("url != ''")


def _commas(*parts: Column | str) -> Column:
    return F.concat_ws(", ", *[_filled(F.trim(p)) for p in parts])


def _first(*parts: Column | str) -> Column:
    return F.coalesce(*[_filled(p) for p in parts])


def _lines(parts: Column) -> Column:
    """Sections of markup as lines of text; empty ones are left out. The sections are cleaned together, as
    one text with a mark between them that markup cannot hold."""
    mark = "\u0001"
    whole = F.array_join(F.transform(F.filter(parts, lambda s: s.isNotNull()), lambda s: F.replace(s, F.lit(mark), F.lit(" "))), mark)
    return F.array_join(F.filter(F.transform(F.split(_encoded_sections(whole, mark), mark), lambda s: F.trim(s)), lambda s: s != ""), "\n")


def _encoded_sections(text: Column, mark: str) -> Column:
    from jobloom.functions.markup import one_line, unescape

    # A tag ends with its section at the latest.
    return one_line(unescape(F.regexp_replace(text, f"<[^>{mark}]*>", " ")))


def _arrangement(kind: Column | str, remote: Column | str) -> Column:
    named = work_arrangement(F.coalesce(kind if isinstance(kind, Column) else F.col(kind), F.lit("")))
    return F.when((named == "unspecified") & F.coalesce(F.col(remote), F.lit(False)), "remote").otherwise(named) if isinstance(remote, str) else named


def greenhouse(p: DataFrame) -> DataFrame:
    schema = "jobs array<struct<id:bigint,absolute_url:string,title:string,content:string,first_published:string,location:struct<name:string>,departments:array<struct<name:string>>>>"
    return _rows(p, schema, "jobs", {
        "source_id": F.col("j.id"), "url": F.col("j.absolute_url"), "title": F.col("j.title"), "location": F.col("j.location.name"), "department": F.get("j.departments", 0)["name"],
        "body": encoded_twice(F.col("j.content")), "published": F.try_to_timestamp("j.first_published")})


def lever(p: DataFrame) -> DataFrame:
    schema = "array<struct<id:string,hostedUrl:string,text:string,createdAt:bigint,workplaceType:string,description:string,additional:string,categories:struct<location:string,department:string>,lists:array<struct<text:string,content:string>>>>"
    lists = F.flatten(F.transform(F.coalesce("j.lists", F.array()), lambda x: F.array(x["text"], x["content"])))
    return _rows(p, schema, "", {
        "source_id": F.col("j.id"), "url": F.col("j.hostedUrl"), "title": F.col("j.text"), "location": F.col("j.categories.location"), "department": F.col("j.categories.department"),
        "work_arrangement": work_arrangement(F.coalesce("j.workplaceType", F.lit(""))), "body": _lines(F.concat(F.array("j.description"), lists, F.array("j.additional"))),
        "published": F.when(F.col("j.createdAt") > 0, F.timestamp_millis("j.createdAt"))})


def ashby(p: DataFrame) -> DataFrame:
    schema = "jobs array<struct<id:string,jobUrl:string,title:string,location:string,department:string,isRemote:boolean,workplaceType:string,descriptionPlain:string,publishedAt:string,address:struct<postalAddress:struct<addressCountry:string>>>>"
    country = F.col("j.address.postalAddress.addressCountry")
    return _rows(p, schema, "jobs", {
        "source_id": F.col("j.id"), "url": F.col("j.jobUrl"), "title": F.col("j.title"), "location": _first("j.location", country), "country_hint": country, "department": F.col("j.department"),
        "work_arrangement": _arrangement("j.workplaceType", "j.isRemote"), "body": F.col("j.descriptionPlain"), "published": F.try_to_timestamp("j.publishedAt")})


def recruitee(p: DataFrame) -> DataFrame:
    schema = "offers array<struct<id:bigint,careers_url:string,title:string,location:string,department:string,description:string,requirements:string,published_at:string,locations:array<struct<name:string,city:string,state:string,country:string,country_code:string>>>>"
    at = F.get("j.locations", 0)
    return _rows(p, schema, "offers", {
        "source_id": F.col("j.id"), "url": F.col("j.careers_url"), "title": F.col("j.title"), "department": F.col("j.department"),
        "location": _first("j.location", at["name"], _commas(at["city"], at["state"], at["country"])), "country_hint": _first(at["country_code"], at["country"]),
        "body": _lines(F.array("j.description", "j.requirements")), "published": F.try_to_timestamp(F.regexp_replace("j.published_at", " UTC$", "Z"))})


def workable(p: DataFrame) -> DataFrame:
    place = "country:string,region:string,city:string"
    schema = f"jobs array<struct<shortcode:string,url:string,shortlink:string,application_url:string,title:string,city:string,state:string,country:string,department:string,telecommuting:boolean,workplace_type:string,description:string,published_on:string,created_at:string,locations:array<struct<{place}>>>>"
    at = F.get("j.locations", 0)
    day = lambda c: F.when(F.col(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(c))
    return _rows(p, schema, "jobs", {
        "source_id": F.col("j.shortcode"), "url": _first("j.url", "j.shortlink", "j.application_url"), "title": F.col("j.title"), "department": F.col("j.department"),
        "location": _first(_commas("j.city", "j.state", "j.country"), _commas(at["city"], at["region"], at["country"])), "country_hint": _first("j.country", at["country"]),
        "work_arrangement": _arrangement("j.workplace_type", "j.telecommuting"), "body": encoded_once(F.col("j.description")), "published": F.coalesce(day("j.published_on"), day("j.created_at"))})


def smartrecruiters(p: DataFrame) -> DataFrame:
    """Of payloads that hold one posting each; lists of postings only count, see :func:`boards`."""
    part = "struct<title:string,text:string>"
    schema = f"id string, name string, postingUrl string, releasedDate string, location struct<city:string,country:string,remote:boolean>, department struct<label:string>, function struct<label:string>, jobAd struct<sections:struct<companyDescription:{part},jobDescription:{part},qualifications:{part},additionalInformation:{part}>>"
    sections = [f"j.jobAd.sections.{s}.{f}" for s in ("companyDescription", "jobDescription", "qualifications", "additionalInformation") for f in ("title", "text")]
    return _listings(p.select("tenant", F.from_json("payload", schema).alias("j")), {
        "source_id": F.col("j.id"), "url": F.col("j.postingUrl"), "title": F.col("j.name"), "location": _commas("j.location.city", "j.location.country"), "country_hint": F.col("j.location.country"),
        "department": _first("j.department.label", "j.function.label"), "work_arrangement": F.when(F.col("j.location.remote"), "remote").otherwise("unspecified"),
        "body": _lines(F.array(*sections)), "published": F.try_to_timestamp("j.releasedDate")})


def manatal(p: DataFrame) -> DataFrame:
    schema = "items array<struct<id:string,translations:array<struct<name:string,description:string>>,location:struct<city:string,state:string,country:string>,client:struct<name:string>>>"
    said = lambda f: F.get(F.filter(F.transform("j.translations", lambda t: t[f]), lambda x: x != ""), F.lit(0))
    url = F.when(F.col("j.id") != "", F.concat(F.lit("https://"), "tenant", F.lit(".careers-page.com/jobs/"), "j.id"))
    return _rows(p, schema, "items", {
        "source_id": F.col("j.id"), "url": url, "title": said("name"), "location": _commas("j.location.city", "j.location.state", "j.location.country"), "country_hint": F.col("j.location.country"),
        "department": F.col("j.client.name"), "body": encoded_once(said("description"))})


def softgarden(p: DataFrame) -> DataFrame:
    address = "streetAddress:string,postalCode:string,addressLocality:string,addressRegion:string,addressCountry:string"
    schema = f"dataFeedElement array<struct<item:struct<identifier:struct<value:string>,url:string,title:string,description:string,datePosted:string,jobLocation:struct<address:struct<{address}>>>>>"
    said = lambda c: F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("-"))
    parts = F.array_compact(F.array(*[said("j.item.jobLocation.address." + f.split(":")[0]) for f in address.split(",")]))
    # The first of parts that differ in case only.
    different = F.aggregate(parts, F.array().cast("array<string>"), lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.array_append(seen, x)))
    return _rows(p, schema, "dataFeedElement", {
        "source_id": F.col("j.item.identifier.value"), "url": F.col("j.item.url"), "title": F.col("j.item.title"), "location": F.array_join(different, ", "), "department": F.lit(""),
        "country_hint": said("j.item.jobLocation.address.addressCountry"), "body": encoded_once(F.col("j.item.description")), "published": F.try_to_timestamp("j.item.datePosted")})


def personio(p: DataFrame) -> DataFrame:
    schema = "position array<struct<id:string,name:string,office:string,department:string,createdAt:string,additionalOffices:struct<office:array<string>>,jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>>>"
    url = F.when(F.col("j.id") != "", F.concat(F.lit("https://"), "tenant", F.lit(".jobs.personio.de/job/"), "j.id"))
    offices = F.filter(F.transform(F.concat(F.array("j.office"), F.coalesce("j.additionalOffices.office", F.array())), lambda x: F.trim(x)), lambda x: x != "")
    sections = F.flatten(F.transform(F.coalesce("j.jobDescriptions.jobDescription", F.array()), lambda d: F.array(d["name"], d["value"])))
    return _rows(p, schema, "position", {
        "source_id": F.col("j.id"), "url": url, "title": F.col("j.name"), "location": F.array_join(offices, ", "), "department": F.col("j.department"), "body": _lines(sections),
        "published": F.try_to_timestamp("j.createdAt")}, xml=True)


def teamtailor(p: DataFrame) -> DataFrame:
    schema = "channel struct<item:array<struct<title:string,link:string,description:string,pubDate:string,department:string,locations:struct<location:array<struct<name:string,city:string,country:string>>>>>>"
    published = F.try_to_timestamp(F.regexp_replace("j.pubDate", r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))
    at = F.get("j.locations.location", 0)
    source_id = F.regexp_extract("j.link", r"^[^?#]*/([0-9]+)(?:-[^/?#]*)?/*(?:[?#].*)?$", 1)
    return _rows(p, schema, "channel.item", {
        "source_id": source_id, "url": F.col("j.link"), "title": F.col("j.title"), "location": _first(at["name"], _commas(at["city"], at["country"])), "country_hint": at["country"],
        "department": F.col("j.department"), "body": encoded_once(F.col("j.description")), "published": published}, xml=True)


FEEDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "greenhouse": greenhouse, "lever": lever, "ashby": ashby, "recruitee": recruitee, "workable": workable, "smartrecruiters": smartrecruiters,
    "manatal": manatal, "softgarden": softgarden, "personio": personio, "teamtailor": teamtailor,
}

#: What a page of a board announces: how many postings there are in all, and how many it holds.
_ANNOUNCED = {"smartrecruiters": "totalFound bigint, content array<struct<id:string>>", "manatal": "total bigint, items array<struct<id:string>>"}


def boards(provider: str, payloads: DataFrame, listings: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(tenant, n_listings, complete) of each board of ``payloads``. A board is complete if nothing of it is
    in ``failed`` (tenant) and, if it is read in pages, the pages hold all that it announces last and
    no fewer listings came of it. A board without any payload is not known."""
    n = listings.groupBy("tenant").agg(F.count("*").alias("n_listings"))
    if provider in _ANNOUNCED:
        total, items = (f.split(" ")[0] for f in _ANNOUNCED[provider].split(", "))
        page = payloads.select("tenant", F.from_json("payload", _ANNOUNCED[provider]).alias("p")).select("tenant", F.col(f"p.{total}").alias("total"), F.coalesce(F.size(f"p.{items}"), F.lit(0)).alias("held"))
        known = page.groupBy("tenant").agg(F.max("total").alias("announced"), F.sum(F.when(F.col("total").isNotNull(), F.col("held"))).alias("held"))
    else:
        known = payloads.select("tenant").distinct().withColumn("announced", F.lit(0).cast("long")).withColumn("held", F.lit(0).cast("long"))
    out = known.join(n, "tenant", "left").withColumn("n_listings", F.coalesce("n_listings", F.lit(0)))
    whole = F.col("announced").isNotNull() & (F.col("held") >= F.col("announced")) & (F.col("n_listings") >= F.col("announced"))
    if failed is not None:
        out = out.join(failed.select("tenant", F.lit(True).alias("failed_")).distinct(), "tenant", "left")
        whole = whole & F.col("failed_").isNull()
    return out.select("tenant", "n_listings", F.coalesce(whole, F.lit(False)).alias("complete"))
