"""Registered queries of identity, catalog, edits, frontier and scorecards, each with its SQL.

The tables hold no board URLs, so most queries read customers as career pages at URLs made from
their keys: boards, own sites, shared domains, aggregators, postings, and text that is no URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import identity
from jobloom.operators import catalog, edits, evaluate, frontier, gate
from jobloom.plans.registered import _ts, query, t

NOW = "2024-06-01"


def career_pages(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, url, company_key): a third belong to the company of their URL."""
    k = F.col("c_custkey")
    acme = F.concat(F.lit("Acme"), (k % 20).cast("string"))
    low, own = F.lower(acme), k.cast("string")
    shapes = [
        F.concat(F.lit("https://boards.greenhouse.io/"), acme), F.concat(F.lit("https://boards.greenhouse.io/"), acme, F.lit("/jobs/"), own),
        F.concat(F.lit("https://"), low, F.lit(".recruitee.com/")), F.concat(F.lit("https://"), low, F.lit(".recruitee.com/o/dev?x=1")),
        F.concat(F.lit("https://www."), low, F.lit(".co.uk/careers/")), F.concat(F.lit("http://join.com/companies/"), acme, F.lit("/")),
        F.concat(F.lit("https://"), low, F.lit(".substack.com/p/x")), F.concat(F.lit("https://de.indeed.com/jobs/"), own),
        F.concat(F.lit("https://careers."), low, F.lit(".com/en/jobs/dev-"), own), F.concat(F.lit("no url "), own)]
    pages = t(spark, d, "customer").select(k.alias("page_id"), F.element_at(F.array(*shapes), (k % 10 + 1).cast("int")).alias("url"))
    pages = identity.with_once(pages, b=identity.board(F.col("url")))
    owner = F.when(F.col("page_id") % 3 == 0, identity.identify(F.col("url"), F.col("b"))["company_key"]).otherwise(F.concat(F.lit("other"), (F.col("page_id") % 7).cast("string")))
    return identity.with_once(pages, company_key=owner).select("page_id", "url", "company_key")


PAGES = r"""base AS (
  SELECT c_custkey AS page_id, ['https://boards.greenhouse.io/Acme' || n, 'https://boards.greenhouse.io/Acme' || n || '/jobs/' || c_custkey,
    'https://acme' || n || '.recruitee.com/', 'https://acme' || n || '.recruitee.com/o/dev?x=1', 'https://www.acme' || n || '.co.uk/careers/', 'http://join.com/companies/Acme' || n || '/',
    'https://acme' || n || '.substack.com/p/x', 'https://de.indeed.com/jobs/' || c_custkey, 'https://careers.acme' || n || '.com/en/jobs/dev-' || c_custkey, 'no url ' || c_custkey][CAST(c_custkey % 10 AS INT) + 1] AS url
  FROM (SELECT c_custkey, c_custkey % 20 AS n FROM customer)),
parts AS (
  SELECT *, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM base),
segs AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg, string_split(host, '.') AS lab FROM parts),
ident AS (
  SELECT *, CASE WHEN host = 'boards.greenhouse.io' THEN 'greenhouse' WHEN host LIKE '%.recruitee.com' THEN 'recruitee' WHEN host = 'join.com' AND lower(seg[1]) = 'companies' THEN 'join' ELSE '' END AS provider,
    array_to_string(list_slice(lab, CASE WHEN host LIKE '%.co.uk' THEN -3 ELSE -2 END, -1), '.') AS domain FROM segs),
pg AS (
  SELECT *, CASE provider WHEN 'greenhouse' THEN 'greenhouse:' || lower(seg[1]) WHEN 'recruitee' THEN 'recruitee:' || lab[-3] WHEN 'join' THEN 'join:' || lower(seg[2]) ELSE CASE WHEN domain = 'substack.com' THEN host ELSE domain END END AS key,
    CASE provider WHEN 'greenhouse' THEN CASE WHEN len(seg) = 1 THEN 'career_page' ELSE 'job_listing' END WHEN 'recruitee' THEN CASE WHEN len(seg) = 0 THEN 'career_page' ELSE 'job_listing' END
      WHEN 'join' THEN CASE WHEN len(seg) = 2 THEN 'career_page' ELSE 'job_listing' END ELSE 'unknown' END AS role,
    CASE provider WHEN 'greenhouse' THEN 'https://boards.greenhouse.io/' || lower(seg[1]) WHEN 'recruitee' THEN 'https://' || host WHEN 'join' THEN 'https://join.com/companies/' || lower(seg[2])
      ELSE CASE WHEN host = '' THEN url ELSE 'https://' || host || rtrim(path, '/') END END AS final FROM ident),
owned AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN key ELSE 'other' || page_id % 7 END AS company_key FROM pg)"""
PLAN = f"""{PAGES}, rest AS (SELECT *, CASE WHEN company_key = key AND url = final THEN 0 WHEN company_key = key THEN 1 WHEN url = final THEN 2 ELSE 3 END AS rank FROM owned
  WHERE host <> '' AND domain <> 'indeed.com' AND role <> 'job_listing' AND NOT (role = 'unknown' AND list_contains(list_slice(seg, 1, len(seg) - 1), 'jobs'))),
firsts AS (SELECT *, first_value(page_id) OVER (PARTITION BY key, final ORDER BY rank, page_id) AS best FROM rest),
plan AS (
  SELECT page_id, CASE WHEN page_id <> best THEN 'merge' WHEN company_key = key THEN 'keep' ELSE 'reattribute' END AS action, key AS company_key, CASE WHEN page_id <> best THEN best END AS merge_into FROM firsts
  UNION ALL SELECT page_id, CASE WHEN host = '' THEN 'keep' ELSE 'delete' END, company_key, NULL FROM owned WHERE page_id NOT IN (SELECT page_id FROM rest))"""


@query(f"WITH {PAGES} SELECT page_id, url, key AS company_key, provider, role, final AS stored_url FROM owned")
def company_identity(spark, d):
    u, b = F.col("url"), F.col("b")
    pages = career_pages(spark, d).select("page_id", "url")
    pages = identity.with_once(identity.with_once(pages, b=identity.board(u)), who=identity.identify(u, b))
    return pages.select("page_id", "url", "who.company_key", "who.provider", identity.role(u, b).alias("role"), identity.stored_page_url(u, b).alias("stored_url"))


def _companies(pages: DataFrame) -> DataFrame:
    return pages.select("company_key").distinct()


@query(f"WITH {PLAN} SELECT * FROM plan")
def doctor_plan(spark, d):
    pages = career_pages(spark, d)
    return catalog.doctor_plan(pages, _companies(pages))


@query(f"WITH {PLAN} SELECT DISTINCT company_key FROM owned WHERE company_key NOT IN (SELECT company_key FROM plan WHERE action IN ('keep', 'reattribute'))")
def doctor_orphans(spark, d):
    pages = career_pages(spark, d)
    return catalog.orphan_companies(catalog.doctor_plan(pages, _companies(pages)), _companies(pages))


@query(f"""WITH {PLAN} SELECT o_orderkey AS listing, coalesce(merge_into, page_id) AS career_page_id FROM orders LEFT JOIN plan ON page_id = o_custkey WHERE action IS DISTINCT FROM 'delete'""")
def doctor_listings(spark, d):
    pages = career_pages(spark, d)
    listings = t(spark, d, "orders").select(F.col("o_orderkey").alias("listing"), F.col("o_custkey").alias("career_page_id"))
    companies = _companies(pages)
    return catalog.apply_plan(catalog.doctor_plan(pages, companies), pages, companies, listings)[2]


@query("""WITH p AS (SELECT o_custkey, to_json(list({'url': 'https://x.org/' || o_orderkey, 'firstSeen': strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), 'lastSeen': '2024-06-01T00:00:00Z'} ORDER BY 'https://x.org/' || o_orderkey)) AS pages FROM orders GROUP BY 1)
SELECT c_name AS company_key, '{"companyKey":"' || c_name || '","atsProvider":"","name":"' || c_name || '"' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',"website":"https://w' || c_custkey || '.org"' END
  || ',"firstSeen":"2024-01-10T00:00:00Z","lastSeen":"2024-03-01T00:00:00Z","careerPages":' || coalesce(CAST(pages AS VARCHAR), '[]') || '}' AS line FROM customer LEFT JOIN p ON o_custkey = c_custkey""")
def catalog_ndjson(spark, d):
    none = F.lit(None).cast("string")
    k = F.col("c_custkey")
    site = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("https://w"), k.cast("string"), F.lit(".org")))
    c = t(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("company_key"), F.col("c_name").alias("name"), none.alias("ats_provider"), none.alias("display_domain"), site.alias("website"), _ts("2024-01-10").alias("first_seen"), _ts("2024-03-01").alias("last_seen"))
    names = c.select(F.col("id").alias("o_custkey"), "company_key")
    p = t(spark, d, "orders").join(names, "o_custkey").select("company_key", F.concat(F.lit("https://x.org/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderdate").cast("timestamp").alias("first_seen"), _ts(NOW).alias("last_seen"))
    return catalog.export_lines(c.drop("id"), p)


@query("""WITH c AS (SELECT c_custkey AS line, c_custkey % 8 AS v, 'k' || c_custkey AS n FROM customer)
SELECT line, CASE v WHEN 3 THEN 'invalid json' WHEN 4 THEN 'record has no identity: set companyKey, website, or careerPages' WHEN 5 THEN 'career pages derive multiple companies (a.com, b.com); split the record or set companyKey'
    WHEN 6 THEN 'website "ftp://' || n || '.org": must be an absolute http(s) url' END AS error,
  CASE v WHEN 0 THEN 'lever:' || n WHEN 1 THEN n || '.org' WHEN 2 THEN 'greenhouse:' || n END AS company_key, CASE v WHEN 0 THEN 'lever' WHEN 1 THEN '' WHEN 2 THEN 'greenhouse' END AS ats_provider,
  CASE v WHEN 0 THEN n WHEN 1 THEN 'Name' WHEN 2 THEN n END AS name, CASE v WHEN 0 THEN '' WHEN 1 THEN n || '.org' WHEN 2 THEN '' END AS display_domain,
  CASE v WHEN 0 THEN '' WHEN 1 THEN 'https://w.org/p' WHEN 2 THEN 'https://boards.greenhouse.io/' || n END AS pages,
  CASE v WHEN 0 THEN '' WHEN 1 THEN 'career page url "x": must be an absolute http(s) url' WHEN 2 THEN '' END AS page_errors
FROM c WHERE v <> 7""")
def import_resolve(spark, d):
    n = F.concat(F.lit("k"), F.col("c_custkey").cast("string"))
    line = lambda s: F.replace(F.lit(s), F.lit("@"), n)
    shapes = [
        '{"companyKey":"lever:@"}', '{"website":"https://www.@.org/","name":"Name","careerPages":[{"url":"x"},{"url":"https://w.org/p/?q=1"}]}',
        '{"careerPages":[{"url":"https://boards.greenhouse.io/@/jobs/1"}]}', '{"companyKey":"@"', '{"name":"@"}',
        '{"careerPages":[{"url":"https://b.com/x"},{"url":"https://a.com"},{"url":"https://www.b.com/@"}]}', '{"companyKey":"@","website":"ftp://@.org"}', " ",
    ]
    lines = t(spark, d, "customer").select(F.col("c_custkey").alias("line"), F.element_at(F.array(*map(line, shapes)), (F.col("c_custkey") % 8 + 1).cast("int")).alias("raw"))
    r = catalog.resolve_import(lines)
    text = lambda c: F.when(F.col("error").isNull(), F.array_join(c, "|"))
    return r.select("line", "error", "company.company_key", "company.ats_provider", "company.name", "company.display_domain", text(F.transform("pages", lambda p: p["url"])).alias("pages"), text(F.col("page_errors")).alias("page_errors"))


# --- edits ----------------------------------------------------------------------------------


@query(f"""WITH l AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS c, o_orderkey % 3 AS s, ['alive', 'dead', 'inconclusive', 'inconclusive', NULL][CAST(left(o_orderpriority, 1) AS INT)] AS o, o_orderdate AS seen FROM orders)
SELECT k AS canonical_url, CASE WHEN o = 'inconclusive' THEN s + 1 WHEN o IS NULL THEN s ELSE 0 END AS inconclusive_streak, CASE WHEN o = 'alive' THEN TIMESTAMP '{NOW}' ELSE seen END AS last_seen,
  CASE WHEN o IS NULL THEN c WHEN o = 'alive' THEN NULL WHEN o = 'dead' OR s + 1 >= 3 THEN coalesce(c, TIMESTAMP '{NOW}') ELSE c END AS closed_at FROM l""")
def apply_probes(spark, d):
    k = F.col("o_orderkey")
    o = t(spark, d, "orders")
    listings = o.select(k.alias("canonical_url"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("closed_at"), (k % 3).alias("inconclusive_streak"), F.col("o_orderdate").alias("last_seen"))
    outcome = F.element_at(F.array(*map(F.lit, ["alive", "dead", "inconclusive", "inconclusive", "none"])), F.left("o_orderpriority", F.lit(1)).cast("int"))
    return edits.apply_probes(listings, o.filter("o_orderpriority <> '5-LOW'").select(k.alias("canonical_url"), outcome.alias("outcome")), _ts(NOW))


def _probed(spark, d):
    """Customers as pages: as many failures as a fifth of their nation's number; probed by segment."""
    c, k, segment = t(spark, d, "customer"), F.col("c_custkey"), F.col("c_mktsegment")
    pages = c.select(k.alias("page_id"), F.floor(F.col("c_nationkey") / 5).alias("consecutive_failures"), _ts("2024-01-01").alias("last_ok"))
    outcome = F.when(segment == "AUTOMOBILE", "alive").when(segment == "MACHINERY", "dead").otherwise("inconclusive")
    return edits.record_probes(pages, c.filter(segment != "BUILDING").select(k.alias("page_id"), outcome.alias("outcome")), _ts(NOW))


PROBED = f"""c AS (SELECT c_custkey AS page_id, CAST(c_nationkey // 5 AS BIGINT) AS n, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS o FROM customer),
probed AS (SELECT page_id, CASE o WHEN 1 THEN 0 WHEN 2 THEN n + 1 ELSE n END AS consecutive_failures, CASE WHEN o = 1 THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2024-01-01' END AS last_ok, o = 2 AND n = 4 AS became_dormant FROM c)"""


@query(f"WITH {PROBED} SELECT * FROM probed")
def record_probes(spark, d):
    return _probed(spark, d)


@query(f"""WITH {PROBED} SELECT o_orderkey, o_custkey AS career_page_id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate WHEN became_dormant THEN TIMESTAMP '{NOW}' END AS closed_at FROM orders LEFT JOIN probed ON page_id = o_custkey""")
def close_dormant(spark, d):
    listings = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("career_page_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("closed_at"))
    return edits.close_dormant(listings, _probed(spark, d), _ts(NOW))


@query("""SELECT o_orderkey AS canonical_url, CASE WHEN o_orderstatus = 'F' THEN 'new ' || o_orderkey ELSE o_clerk END AS description, CASE WHEN o_orderstatus = 'F' THEN 'jsonld' ELSE 'flattened' END AS description_source,
  CASE WHEN c_mktsegment = 'BUILDING' THEN o_custkey + 1 ELSE o_custkey END AS career_page_id FROM (SELECT *, o_orderpriority AS o_clerk FROM orders) LEFT JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IS DISTINCT FROM 'MACHINERY'""")
def listing_edits(spark, d):
    k = F.col("o_orderkey")
    o = t(spark, d, "orders")
    listings = o.select(k.alias("canonical_url"), F.col("o_orderpriority").alias("description"), F.lit("flattened").alias("description_source"), F.col("o_custkey").alias("career_page_id"))
    bodies = o.filter("o_orderstatus = 'F'").select(k.alias("canonical_url"), F.concat(F.lit("new "), k.cast("string")).alias("description"), F.lit("jsonld").alias("description_source"))
    pages = t(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), "c_mktsegment")
    moves = pages.filter("c_mktsegment = 'BUILDING'").withColumn("to_page_id", F.col("page_id") + 1)
    gone = pages.filter("c_mktsegment = 'MACHINERY'")
    return edits.repoint_listings(edits.delete_listings(edits.update_descriptions(listings, bodies), gone), moves)


# --- frontier -------------------------------------------------------------------------------


@query("""WITH h AS (SELECT l_suppkey AS host, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1),
e AS (SELECT host, seq, CASE WHEN s_nationkey < 18 THEN TIMESTAMP '2024-05-31 23:00:00' + to_minutes(CAST(s_nationkey * 5 AS INT)) END AS next_eligible FROM h LEFT JOIN supplier ON s_suppkey = host)
SELECT host, 'u' || seq AS url, seq, TIMESTAMP '2024-06-01 00:02:00' AS expires FROM e WHERE next_eligible IS NULL OR next_eligible <= TIMESTAMP '2024-06-01' ORDER BY next_eligible NULLS FIRST, host LIMIT 40""")
def frontier_pop(spark, d):
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    queue = t(spark, d, "lineitem").select(F.concat(F.lit("u"), seq.cast("string")).alias("url"), F.col("l_suppkey").alias("host"), seq.alias("seq"))
    host = F.col("s_suppkey")
    hosts = t(spark, d, "supplier").filter("s_nationkey < 18").select(host.alias("host"), (_ts("2024-05-31 23:00:00") + F.make_dt_interval(mins=F.col("s_nationkey") * 5)).alias("next_eligible"))
    return frontier.pop(queue, hosts, _ts(NOW), 40)[0]


@query("""WITH n AS (SELECT l_partkey AS url, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1), every AS (
  SELECT p_partkey AS url, CAST(-p_partkey AS BIGINT) AS seq FROM part WHERE p_retailprice < 950 UNION ALL SELECT * FROM n WHERE url NOT IN (SELECT p_partkey FROM part WHERE p_retailprice < 950))
SELECT * FROM every ORDER BY seq DESC, url DESC LIMIT 150""")
def frontier_admit(spark, d):
    seen = t(spark, d, "part").filter("p_retailprice < 950").select(F.col("p_partkey").alias("url"), (-F.col("p_partkey")).cast("long").alias("seq"))
    urls = t(spark, d, "lineitem").select(F.col("l_partkey").alias("url"), F.col("l_suppkey").alias("host"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return frontier.admit(seen, urls, 150)[0]


# --- scorecards -----------------------------------------------------------------------------


def _verdicts(spark, d):
    k = F.col("c_custkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    return t(spark, d, "customer").select(
        k.alias("url"), pick(["hub_ats_root", "aggregator", "hub_self", "content"], k % 4).alias("category"), (k % 4).isin(0, 2).alias("positive"),
        pick(["reject", "uncertain", "certain_accept"], k % 3).alias("outcome"), (k % 5 == 0).alias("accepted"))


VERDICTS = """v AS (SELECT c_custkey AS url, c_custkey % 4 AS c, c_custkey % 4 IN (0, 2) AS positive, c_custkey % 3 AS o, c_custkey % 5 = 0 AS ok FROM customer),
f AS (SELECT url, 'leak' AS finding FROM v WHERE positive AND o = 0 UNION ALL SELECT url, CASE WHEN ok THEN 'accepted_false_certain' ELSE 'false_certain' END FROM v WHERE NOT positive AND o = 2
  UNION ALL SELECT url, 'violation' FROM v WHERE (c = 0 AND o <> 2) OR (c = 1 AND o <> 0))"""


@query(f"WITH {VERDICTS} SELECT * FROM f")
def gate_findings(spark, d):
    return evaluate.gate_findings(_verdicts(spark, d))


@query(f"""WITH {VERDICTS}, n AS (SELECT count(*) FILTER (WHERE finding = 'leak') AS leaks, count(*) FILTER (WHERE finding = 'false_certain') AS false_certains, count(*) FILTER (WHERE finding = 'accepted_false_certain') AS accepted_false_certains, count(*) FILTER (WHERE finding = 'violation') AS violations FROM f)
SELECT (SELECT count(*) FROM v) AS total, (SELECT count(*) FROM v WHERE o = 1) AS llm_calls, round((SELECT count(*) FROM v WHERE o = 1) / (SELECT count(*) FROM v), 4) AS llm_call_rate, * FROM n""")
def gate_scorecard(spark, d):
    return evaluate.gate_scorecard(_verdicts(spark, d))


EXTRACTS = "x AS (SELECT c_custkey AS url, ['detail', 'hub-index', 'residue', 'ambiguous'][CAST(c_custkey % 4 AS INT) + 1] AS label, c_custkey % 3 <> 0 AS extract, c_custkey % 7 + 0.5 AS w, c_custkey % 5 = 0 AS ok, c_custkey % 6 = 1 AS want FROM customer)"


def _extracts(spark, d):
    k = F.col("c_custkey")
    label = F.element_at(F.array(*map(F.lit, ["detail", "hub-index", "residue", "ambiguous"])), (k % 4 + 1).cast("int"))
    return t(spark, d, "customer").select(k.alias("url"), label.alias("label"), (k % 3 != 0).alias("extract"), (k % 7 + F.lit(0.5)).alias("weight"), (k % 3 != 0).alias("free"), (k % 5 == 0).alias("accepted"), (k % 6 == 1).alias("expected"))


@query(f"""WITH {EXTRACTS}, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE extract) AS extract_calls, count(*) FILTER (WHERE label = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE label = 'ambiguous' AND extract) AS ambiguous_extracted,
  count(*) FILTER (WHERE label = 'residue') AS residue, count(*) FILTER (WHERE label = 'residue' AND extract) AS residue_extracted, count(*) FILTER (WHERE label = 'detail' AND extract) AS tp, count(*) FILTER (WHERE label IN ('hub-index', 'residue') AND extract) AS fp,
  count(*) FILTER (WHERE label = 'detail' AND NOT extract) AS fn, count(*) FILTER (WHERE label IN ('hub-index', 'residue') AND NOT extract) AS tn FROM x),
r AS (SELECT *, round(extract_calls / total, 4) AS extract_call_rate, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall FROM s) SELECT *, round(2 * precision * recall / (precision + recall), 4) AS f1 FROM r""")
def extract_scorecard(spark, d):
    return evaluate.extract_scorecard(_extracts(spark, d))


@query(f"""WITH {EXTRACTS} SELECT count(*) AS total, count(*) FILTER (WHERE extract) AS free, count(*) FILTER (WHERE label = 'detail') AS details, count(*) FILTER (WHERE label = 'detail' AND extract) AS details_free,
  count(*) FILTER (WHERE extract AND label <> 'detail' AND NOT (ok AND label = 'residue')) AS fired_on_non_posting, count(*) FILTER (WHERE extract AND ok AND label = 'residue') AS accepted_fires,
  count(*) FILTER (WHERE extract AND NOT want) AS missing_expectation, count(*) FILTER (WHERE NOT extract AND want) AS unused_expectation, round(count(*) FILTER (WHERE extract) / count(*), 4) AS free_rate,
  round(CAST(sum(w) FILTER (WHERE extract) AS DOUBLE) / CAST(sum(w) AS DOUBLE), 4) AS stream_free_share, round(count(*) FILTER (WHERE label = 'detail' AND extract) / count(*) FILTER (WHERE label = 'detail'), 4) AS coverage,
  round(CAST(sum(w) FILTER (WHERE label = 'detail' AND extract) AS DOUBLE) / CAST(sum(w) FILTER (WHERE label = 'detail') AS DOUBLE), 4) AS weighted_coverage FROM x""")
def free_scorecard(spark, d):
    return evaluate.free_scorecard(_extracts(spark, d))


@query("""WITH p AS (SELECT p_partkey AS url, p_name AS a, p_brand AS b, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS ga, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS gb FROM part)
SELECT url, 'title' AS field, a AS want, ga AS got FROM p WHERE a IS DISTINCT FROM ga UNION ALL SELECT url, 'location', b, gb FROM p WHERE b IS DISTINCT FROM gb""")
def field_divergences(spark, d):
    k = F.col("p_partkey")
    p = t(spark, d, "part")
    want = p.select(k.alias("url"), F.col("p_name").alias("title"), F.col("p_brand").alias("location"))
    got = p.select(k.alias("url"), F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("title"), F.when(k % 4 != 0, F.col("p_brand")).alias("location"))
    return evaluate.field_divergences(want, got, ["title", "location"])


@query("""WITH a AS (SELECT o_orderstatus AS metric, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus <> 'O' GROUP BY 1), b AS (SELECT o_orderstatus AS metric, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P' GROUP BY 1)
SELECT coalesce(a.metric, b.metric) AS metric, a.v AS before, b.v AS after, round(coalesce(b.v, 0) - coalesce(a.v, 0), 4) AS delta FROM a FULL JOIN b ON a.metric = b.metric""")
def metric_diff(spark, d):
    report = lambda cond: t(spark, d, "orders").filter(cond).groupBy(F.col("o_orderstatus").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return evaluate.metric_diff(report("o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus <> 'O'"), report("o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P'"))


@query("""SELECT user_id AS url, arg_max(event_id, (strftime(ts, '%Y-%m-%d'), event_id)) AS seq, arg_max(event_type = 'error', (strftime(ts, '%Y-%m-%d'), event_id)) AS verdict, count(*) AS n FROM events GROUP BY 1""")
def capture_timeline(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("url"), F.date_format("ts", "yyyy-MM-dd").alias("ts"), (F.col("event_type") == "error").alias("verdict"), F.col("event_id").alias("seq"))
    return evaluate.capture_timeline(e).select("url", "seq", "verdict", F.size("timeline").cast("long").alias("n"))


@query(f"""WITH {PAGES} SELECT page_id, CASE WHEN role = 'career_page' THEN 'ats_board_root' WHEN role = 'job_listing' THEN '' WHEN len(seg) = 0 THEN 'bare_or_locale_root' WHEN seg[-1] = 'careers' THEN 'index_terminal'
  WHEN page_id % 4 = 1 THEN 'ats_embed' WHEN page_id % 30 >= 5 THEN 'job_link_saturation' WHEN page_id % 2 = 0 THEN 'positive_evidence' ELSE '' END AS rung FROM owned""")
def extract_rungs(spark, d):
    i = F.col("page_id")
    return career_pages(spark, d).select("page_id", gate.extract_rung(F.col("url"), i % 30, i % 4 == 1, F.lit(False), i % 2 == 1).alias("rung"))


@query("""SELECT a.item_id, strlen(a.text) > 0 AND (strlen(b.text) = 0 OR strlen(a.text) > 1.8 * strlen(b.text)) OR contains(lower(b.text), 'this job was removed') AS withdrawn FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id - a.item_id % 3""")
def withdrawal_notice(spark, d):
    a = t(spark, d, "benchmark").select("item_id", "text")
    b = a.select(F.col("item_id").alias("other"), F.col("text").alias("body"))
    return a.join(b, F.col("other") == F.col("item_id") - F.col("item_id") % 3).select("item_id", gate.withdrawn(F.col("body"), F.col("text")).alias("withdrawn"))
