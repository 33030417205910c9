import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobloom.functions import identity
from jobloom.operators import catalog, frontier


@pytest.fixture(scope="module")
def facts(spark):
    urls = [
        "https://www.careers-page.com/Acme", "https://api.careers-page.com/x", "https://acme.careers-page.com/de", "https://x.acme.jobs.personio.de/job/1", "https://join.com/acme",
        "https://jobs.lever.co", "https://me@news.acme.co.uk:8080/a", "https://10.0.0.1/jobs", "https://boards.greenhouse.io/embed/job_board?for=%41cme", "nothing", None, "https://a.ghost.io",
    ]
    rows = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    u = F.col("url")
    out = rows.select("i", identity.identify(u).alias("id"), identity.role(u).alias("role"), identity.stored_page_url(u).alias("page"), identity.embed_tenant(u).alias("embed"))
    return {r.i: r for r in out.collect()}


@pytest.mark.parametrize(("i", "key", "role"), [
    (0, "manatal:acme", "career_page"), (1, "careers-page.com", "unknown"), (2, "manatal:acme", "career_page"), (3, "personio:acme", "job_listing"), (4, "join.com", "unknown"),
    (5, "lever.co", "job_listing"), (6, "acme.co.uk", "unknown"), (7, "10.0.0.1", "unknown"), (9, "", "unknown"), (11, "a.ghost.io", "unknown")])
def test_identity_and_role(facts, i, key, role):
    assert (facts[i].id.company_key, facts[i].role) == (key, role)


def test_pages_and_embeds(facts):
    assert facts[3].page == "https://x.acme.jobs.personio.de"
    assert facts[0].page == "https://www.careers-page.com/acme"
    assert tuple(facts[8].embed) == ("greenhouse", "acme")
    assert facts[5].embed is None
    assert facts[10].id.company_key is None


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    (tmp_path / "in.ndjson").write_text("\n".join(["" if i % 5 == 0 else f"line {i}" for i in range(1, 2001)]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = catalog.numbered_lines(spark, str(tmp_path / "in.ndjson")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line, r.raw) for r in rows) == [(i, "" if i % 5 == 0 else f"line {i}") for i in range(1, 2001)]


def test_import_reports_and_round_trip(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    companies = spark.createDataFrame([("acme.org", "", "Acme", None, "https://acme.org", at, at)], "company_key string, ats_provider string, name string, display_domain string, website string, first_seen timestamp, last_seen timestamp")
    pages = spark.createDataFrame([("acme.org", "https://acme.org/b", at, at), ("acme.org", "https://acme.org/a", at, at), ("gone", "https://x.org", at, at)], "company_key string, url string, first_seen timestamp, last_seen timestamp")
    line = catalog.export_lines(companies, pages).first().line
    lines = spark.createDataFrame([(1, line), (2, "  "), (3, "[]x"), (4, '{"companyKey":"k","careerPages":[{"url":"/x"},{"url":null}]}'), (5, None)], "line int, raw string")
    r = catalog.resolve_import(lines)
    first = r.filter("line = 1").first()
    assert [p.url for p in first.pages] == ["https://acme.org/a", "https://acme.org/b"]
    assert (first.company.company_key, first.company.display_domain, first.company.first_seen) == ("acme.org", "acme.org", at)
    assert tuple(catalog.import_report(r).first()) == (2, 2, 3)
    assert [e.line for e in catalog.import_errors(r).collect()] == [3, 4, 4]


def test_doctor_is_idempotent_and_moves_listings(spark):
    pages = spark.createDataFrame(
        [(1, "https://acme.org/careers/", "old"), (2, "https://acme.org/careers", "acme.org"), (3, "https://indeed.com/x", "indeed.com"), (4, "https://b.org/jobs", "old"), (5, "junk", "junk")], "page_id int, url string, company_key string")
    companies = pages.select("company_key").distinct()
    listings = spark.createDataFrame([("l1", 1), ("l2", 2), ("l3", 3), ("l4", None)], "canonical_url string, career_page_id int")
    plan = catalog.doctor_plan(pages, companies)
    assert {r.page_id: (r.action, r.company_key, r.merge_into) for r in plan.collect()} == {
        1: ("merge", "acme.org", 2), 2: ("keep", "acme.org", None), 3: ("delete", "indeed.com", None), 4: ("reattribute", "b.org", None), 5: ("keep", "junk", None)}
    p, c, kept = catalog.apply_plan(plan, pages, companies, listings)
    assert sorted(r.company_key for r in c.collect()) == ["acme.org", "b.org", "junk"]
    assert {r.canonical_url: r.career_page_id for r in kept.collect()} == {"l1": 2, "l2": 2, "l4": None}
    assert {r.action for r in catalog.doctor_plan(p, c).collect()} == {"keep"}


def test_frontier_round(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    now = F.lit("2024-01-01 00:00:10").cast("timestamp")
    queue = spark.createDataFrame([("a1", "a", 2), ("a0", "a", 1), ("b0", "b", 3)], "url string, host string, seq int")
    leases = spark.createDataFrame([("c0", "c", 4, at(9)), ("d0", "d", 5, at(11))], "url string, host string, seq int, expires timestamp")
    hosts = spark.createDataFrame([("a", at(5)), ("b", at(30))], "host string, next_eligible timestamp")
    queue, leases = frontier.reclaim(queue, leases, now)
    assert {r.url for r in leases.collect()} == {"d0"}
    taken, after = frontier.pop(queue, hosts, now, 5)
    assert {r.url for r in taken.collect()} == {"a0", "c0"}
    assert {r.host: r.next_eligible.second for r in after.collect()} == {"a": 11, "b": 30, "c": 11}
    s = frontier.status(queue.filter("host = 'b'"), leases, hosts, now).first()
    assert (s.queued, s.leased, s.verdict, s.wake) == (1, 1, "wait", at(30))
    assert frontier.status(queue.filter("false"), leases.filter("false"), hosts, now).first().verdict == "done"
    seen, admitted = frontier.admit(spark.createDataFrame([("a0", 0)], "url string, seq int"), queue, 2)
    assert {r.url for r in admitted.collect()} == {"a1", "b0", "c0"}
    assert {r.url for r in seen.collect()} == {"b0", "c0"}
