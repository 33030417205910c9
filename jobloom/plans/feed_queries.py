"""Queries of the job-board feeds, over payloads that are made of the parts table: a board for each brand,
a posting for each part. The SQL says what the mappers must find, from the parts themselves."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.plans.registered import query, t
from jobloom.sources import feeds



def _cols() -> SimpleNamespace:
    """Columns of the parts; by size, a third of the postings each lack something."""
    i, size = F.col("p_partkey"), F.col("p_size")
    html = F.concat(F.lit("<p>"), "p_type", F.lit(" &amp; more</p><ul><li>x &lt;10 y</li><li>&nbsp;z</li></ul>"))
    return SimpleNamespace(
        I=i, ID=i.cast("string"), SMALL=size <= 15, MIDDLE=(size > 15) & (size <= 30), HTML=html,
        URL=F.concat(F.lit("https://x.org/jobs/"), i.cast("string")), DAY=F.lit("2024-03-05T06:07:08Z"))


TEXT = "p_type || ' & more x <10 y z'"
URL_SQL = "'https://x.org/jobs/' || p_partkey"


def _payloads(spark, d, posting: dict[str, Column], wrap: Callable[[Column], Column]) -> DataFrame:
    p = t(spark, d, "part").select(F.translate("p_brand", "#", "-").alias("tenant"), F.struct(*[c.alias(n) for n, c in posting.items()]).alias("j"))
    return p.groupBy("tenant").agg(F.collect_list("j").alias("js")).select("tenant", wrap(F.col("js")).alias("payload"))


def _json(name: str):
    return lambda js: F.to_json(F.struct(js.alias(name)))


def _sql(url: str = URL_SQL, title: str = "p_name", location: str = "''", hint: str = "''", department: str = "''", arrangement: str = "'unspecified'", body: str = TEXT, published: str = "NULL", source_id: str = "'' || p_partkey", where: str = "true") -> str:
    return f"""SELECT translate(p_brand, '#', '-') AS tenant, {source_id} AS source_id, {url} AS url, {title} AS title, {location} AS location, {hint} AS country_hint,
  {department} AS department, {arrangement} AS work_arrangement, {body} AS body, CAST({published} AS TIMESTAMP) AS published FROM part WHERE {where}"""


def _when(condition: Column, value) -> Column:
    return F.when(condition, value if isinstance(value, Column) else F.lit(value))


DAY_SQL = "TIMESTAMP '2024-03-05 06:07:08'"
THIRD = "CASE WHEN p_size <= 15 THEN {} WHEN p_size <= 30 THEN {} ELSE {} END"


@query(_sql(url="CASE WHEN p_size <= 15 THEN NULL ELSE 'https://x.org/jobs/' || p_partkey END", location="p_type", department=THIRD.format("''", "''", "p_type"), published=DAY_SQL, where="p_size > 15"))
def feed_greenhouse(spark, d):
    c = _cols()
    twice = F.replace(F.replace(F.replace(c.HTML, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    posting = {
        "id": c.I, "absolute_url": _when(~c.SMALL, c.URL), "title": F.col("p_name"), "content": twice, "first_published": c.DAY, "location": F.struct(F.col("p_type").alias("name")),
        "departments": F.when(c.MIDDLE, F.array().cast("array<struct<name:string>>")).otherwise(F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.lit("second").alias("name"))))}
    return feeds.greenhouse(_payloads(spark, d, posting, _json("jobs")))


@query(_sql(location="p_type", department="p_type", arrangement=THIRD.format("'remote'", "'onsite'", "'unspecified'"), body=f"{TEXT} || chr(10) || 'You & we' || chr(10) || {TEXT} || CASE WHEN p_size <= 15 THEN chr(10) || 'end' ELSE '' END",
            published=f"CASE WHEN p_size > 30 THEN NULL ELSE {DAY_SQL} END"))
def feed_lever(spark, d):
    c = _cols()
    posting = {
        "id": c.ID, "hostedUrl": c.URL, "text": F.col("p_name"), "createdAt": F.when(F.col("p_size") > 30, 0).otherwise(1709618828000), "workplaceType": F.when(c.SMALL, "Remote").when(c.MIDDLE, "On-Site").otherwise("?"),
        "description": c.HTML, "additional": _when(c.SMALL, "<b>end</b>"), "categories": F.struct(F.col("p_type").alias("location"), F.col("p_type").alias("department")),
        "lists": F.array(F.struct(F.lit("You &amp; we").alias("text"), c.HTML.alias("content")))}
    return feeds.lever(_payloads(spark, d, posting, F.to_json))


@query(_sql(location=THIRD.format("'Austria'", "p_type", "p_type"), hint="'Austria'", department="p_type", arrangement=THIRD.format("'remote'", "'hybrid'", "'unspecified'"), body="p_comment", published=DAY_SQL)
       .replace("p_comment", "p_type"))
def feed_ashby(spark, d):
    c = _cols()
    posting = {
        "id": c.ID, "jobUrl": c.URL, "title": F.col("p_name"), "location": F.when(c.SMALL, "").otherwise(F.col("p_type")), "department": F.col("p_type"), "isRemote": c.SMALL | c.MIDDLE, "workplaceType": _when(c.MIDDLE, "Hybrid"),
        "descriptionPlain": F.col("p_type"), "publishedAt": c.DAY, "address": F.struct(F.struct(F.lit("Austria").alias("addressCountry")).alias("postalAddress"))}
    return feeds.ashby(_payloads(spark, d, posting, _json("jobs")))


@query(_sql(location=THIRD.format("p_type", "'Wien HQ'", "'Wien, Austria'"), hint=THIRD.format("'AT'", "'AT'", "'Austria'"), department="p_type", body=f"{TEXT} || CASE WHEN p_size <= 15 THEN chr(10) || 'must' ELSE '' END", published=DAY_SQL))
def feed_recruitee(spark, d):
    c = _cols()
    place = F.struct(_when(c.MIDDLE, "Wien HQ").alias("name"), F.lit("Wien").alias("city"), F.lit("").alias("state"), F.lit("Austria").alias("country"), _when(c.SMALL | c.MIDDLE, "AT").alias("country_code"))
    posting = {
        "id": c.I, "careers_url": c.URL, "title": F.col("p_name"), "location": _when(c.SMALL, F.col("p_type")), "department": F.col("p_type"), "description": c.HTML, "requirements": _when(c.SMALL, "<i>must</i>"),
        "published_at": F.lit("2024-03-05 06:07:08 UTC"), "locations": F.array(place)}
    return feeds.recruitee(_payloads(spark, d, posting, _json("offers")))


@query(_sql(url=THIRD.format(URL_SQL, "'https://s.org/' || p_partkey", "'https://a.org/' || p_partkey"), location=THIRD.format("'Graz, Austria'", "'Graz, Austria'", "'Wien, Vienna, Austria'"), hint=THIRD.format("'Austria'", "'Austria'", "'Austria'"),
            department="p_type", arrangement=THIRD.format("'remote'", "'hybrid'", "'unspecified'"), published=THIRD.format("TIMESTAMP '2024-03-05'", "TIMESTAMP '2024-02-01'", "NULL")))
def feed_workable(spark, d):
    c = _cols()
    known = c.SMALL | c.MIDDLE
    posting = {
        "shortcode": c.ID, "url": _when(c.SMALL, c.URL), "shortlink": _when(c.MIDDLE, F.concat(F.lit("https://s.org/"), c.ID)), "application_url": F.concat(F.lit("https://a.org/"), c.ID), "title": F.col("p_name"),
        "city": _when(known, " Graz "), "state": F.lit(" "), "country": _when(known, "Austria"), "department": F.col("p_type"), "telecommuting": known, "workplace_type": _when(c.MIDDLE, "hybrid"), "description": c.HTML,
        "published_on": F.when(c.SMALL, "2024-03-05").otherwise("soon"), "created_at": _when(c.MIDDLE, "2024-02-01"),
        "locations": F.array(F.struct(F.lit("Austria").alias("country"), F.lit("Vienna").alias("region"), F.lit("Wien").alias("city")))}
    return feeds.workable(_payloads(spark, d, posting, _json("jobs")))


@query(_sql(location="CASE WHEN p_size <= 15 THEN 'at' ELSE 'Wien, at' END", hint="'at'", department="CASE WHEN p_size <= 15 THEN 'Sales' ELSE p_type END", arrangement="CASE WHEN p_size <= 15 THEN 'remote' ELSE 'unspecified' END",
            body=f"'The job' || chr(10) || {TEXT} || chr(10) || 'More'", published=DAY_SQL))
def feed_smartrecruiters(spark, d):
    c = _cols()
    part = lambda title, text: F.struct(F.lit(title).alias("title"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))
    posting = F.struct(
        c.ID.alias("id"), F.col("p_name").alias("name"), c.URL.alias("postingUrl"), F.lit("2024-03-05T06:07:08.000Z").alias("releasedDate"),
        F.struct(_when(~c.SMALL, "Wien").alias("city"), F.lit("at").alias("country"), c.SMALL.alias("remote")).alias("location"),
        F.struct(_when(~c.SMALL, F.col("p_type")).alias("label")).alias("department"), F.struct(F.lit("Sales").alias("label")).alias("function"),
        F.struct(F.struct(part("", "").alias("companyDescription"), part("The job", c.HTML).alias("jobDescription"), part("", "<br>").alias("qualifications"), part("More", None).alias("additionalInformation")).alias("sections")).alias("jobAd"))
    return feeds.smartrecruiters(t(spark, d, "part").select(F.translate("p_brand", "#", "-").alias("tenant"), F.to_json(posting).alias("payload")))


@query(_sql(url="'https://' || translate(p_brand, '#', '-') || '.careers-page.com/jobs/' || p_partkey", location=THIRD.format("'Austria'", "'Wien, Austria'", "'Wien, Austria'"), hint="'Austria'", department="p_type"))
def feed_manatal(spark, d):
    c = _cols()
    said = lambda name, text: F.struct(name.alias("name"), text.alias("description"))
    posting = {
        "id": c.ID, "translations": F.array(said(F.lit(""), F.lit(None).cast("string")), said(F.col("p_name"), F.lit("")), said(F.lit("other"), c.HTML), said(F.lit("x"), F.lit("y"))),
        "location": F.struct(_when(~c.SMALL, "Wien").alias("city"), F.lit("").alias("state"), F.lit("Austria").alias("country")), "client": F.struct(F.col("p_type").alias("name"))}
    return feeds.manatal(_payloads(spark, d, posting, _json("items")))


@query(_sql(location="'Ring 1, 1010, Wien' || CASE WHEN p_size <= 15 THEN '' ELSE ', Austria' END", hint="CASE WHEN p_size <= 15 THEN '' ELSE 'Austria' END", published="TIMESTAMP '2024-03-05 05:07:08.9'"))
def feed_softgarden(spark, d):
    c = _cols()
    address = F.struct(F.lit("Ring 1").alias("streetAddress"), F.lit("1010").alias("postalCode"), F.lit(" Wien ").alias("addressLocality"), F.lit("WIEN").alias("addressRegion"), F.when(c.SMALL, " - ").otherwise("Austria").alias("addressCountry"))
    item = F.struct(
        F.struct(c.I.alias("value")).alias("identifier"), c.URL.alias("url"), F.col("p_name").alias("title"), c.HTML.alias("description"), F.lit("2024-03-05T06:07:08.900+01:00").alias("datePosted"),
        F.struct(address.alias("address")).alias("jobLocation"))
    return feeds.softgarden(_payloads(spark, d, {"item": item}, _json("dataFeedElement")))


def _xml(js: Column, root: str) -> Column:
    return F.concat(F.lit(f"<{root}>"), F.array_join(js["x"], ""), F.lit(f"</{root.split(' ')[0]}>"))


@query(_sql(url="'https://' || translate(p_brand, '#', '-') || '.jobs.personio.de/job/' || p_partkey", location="'Wien' || CASE WHEN p_size <= 15 THEN '' ELSE ', Graz, Linz' END", department="p_type", body=f"'Tasks' || chr(10) || {TEXT} || chr(10) || 'More' || chr(10) || 'm'", published=DAY_SQL))
def feed_personio(spark, d):
    c = _cols()
    more = F.when(c.SMALL, "").otherwise("<additionalOffices><office>Graz</office><office> </office><office>Linz</office></additionalOffices>")
    x = F.concat(
        F.lit("<position><id>"), c.ID, F.lit("</id><office> Wien </office>"), more, F.lit("<department>"), "p_type", F.lit("</department><name>"), "p_name",
        F.lit("</name><createdAt>2024-03-05T06:07:08+00:00</createdAt><jobDescriptions><jobDescription><name>Tasks</name><value><![CDATA["), c.HTML,
        F.lit("]]></value></jobDescription><jobDescription><name>More</name><value>m</value></jobDescription></jobDescriptions></position>"))
    return feeds.personio(_payloads(spark, d, {"x": x}, lambda js: _xml(js, "workzag-jobs")))


@query(_sql(url="'https://t.org/jobs/' || p_partkey || '-' || CASE WHEN p_size <= 15 THEN 'a-1' ELSE 'b' END", location=THIRD.format("'HQ'", "'Wien, Austria'", "''"), hint=THIRD.format("'Austria'", "'Austria'", "''"), department="p_type", published=DAY_SQL))
def feed_teamtailor(spark, d):
    c = _cols()
    place = lambda name: F.lit(f"<locations><location><name>{name}</name><city>Wien</city><country>Austria</country></location><location><name>second</name></location></locations>")
    x = F.concat(
        F.lit("<item><title>"), "p_name", F.lit("</title><link>https://t.org/jobs/"), c.ID, F.when(c.SMALL, "-a-1").otherwise("-b"), F.lit("</link><description><![CDATA["), c.HTML,
        F.lit("]]></description><pubDate>Tue, 05 Mar 2024 07:07:08 +0100</pubDate><department>"), "p_type", F.lit("</department>"),
        F.when(c.SMALL, place("HQ")).when(c.MIDDLE, place("")).otherwise(""), F.lit("</item>"))
    return feeds.teamtailor(_payloads(spark, d, {"x": x}, lambda js: F.concat(F.lit("<rss>"), _xml(js, "channel"), F.lit("</rss>"))))


@query("""WITH b AS (SELECT translate(p_brand, '#', '-') AS tenant, count(*) AS n_listings FROM part GROUP BY 1)
SELECT tenant, n_listings, n_listings % 3 <> 0 AS complete FROM b""")
def feed_completeness(spark, d):
    """Boards read in pages of ten postings; of every third the total says one posting more."""
    p = t(spark, d, "part").select(F.translate("p_brand", "#", "-").alias("tenant"), "p_partkey", "p_name")
    n = p.groupBy("tenant").agg(F.count("*").alias("n"))
    total = F.col("n") + F.when(F.col("n") % 3 == 0, 1).otherwise(0)
    item = F.struct(F.col("p_partkey").cast("string").alias("id"), F.array(F.struct(F.col("p_name").alias("name"))).alias("translations"))
    pages = p.join(n, "tenant").groupBy("tenant", (F.col("p_partkey") / 10).cast("long").alias("page"), total.alias("total")).agg(F.collect_list(item).alias("items"))
    payloads = pages.select("tenant", F.to_json(F.struct("total", "items")).alias("payload"))
    return feeds.boards("manatal", payloads, feeds.manatal(payloads))
