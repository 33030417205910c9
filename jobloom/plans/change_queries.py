"""Queries of sightings, ingest, refetch, seeds, work and the frontier, each with its SQL. Snapshots are laid out from the
tables' own columns, for every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import geo
from jobloom.operators import edits, frontier, ingest, work
from jobloom.plans.registered import _ts, query, t

NOW = "2024-06-01"


@query(f"""WITH o AS (SELECT c_custkey AS k, CASE WHEN c_nationkey < 8 THEN 'lever' END AS p, 'd' || c_custkey AS d, c_name AS n, 'llm' AS s, 'w' || c_custkey AS w FROM customer WHERE c_mktsegment <> 'BUILDING'),
e AS (SELECT user_id AS k, arg_max(event_type, (ts, event_id)) AS t FROM events GROUP BY 1)
SELECT coalesce(o.k, e.k) AS company_key, CASE WHEN e.k IS NULL THEN p WHEN t = 'view' THEN NULL ELSE 'ashby' END AS ats_provider, CASE WHEN e.k IS NULL THEN d ELSE 'seen' || e.k END AS display_domain,
  CASE WHEN e.k IS NULL THEN n ELSE t END AS name, CASE WHEN e.k IS NULL THEN s WHEN t = 'click' THEN NULL ELSE 'jsonld' END AS name_source, w AS website,
  CASE WHEN o.k IS NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2024-01-01' END AS first_seen, CASE WHEN e.k IS NULL THEN TIMESTAMP '2024-02-02' ELSE TIMESTAMP '{NOW}' END AS last_seen FROM o FULL JOIN e ON o.k = e.k""")
def company_sightings(spark, d):
    k = F.col("c_custkey")
    text = k.cast("string")
    old = t(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        k.alias("company_key"), F.when(F.col("c_nationkey") < 8, "lever").alias("ats_provider"), F.concat(F.lit("d"), text).alias("display_domain"), F.col("c_name").alias("name"), F.lit("llm").alias("name_source"),
        F.concat(F.lit("w"), text).alias("website"), _ts("2024-01-01").alias("first_seen"), _ts("2024-02-02").alias("last_seen"))
    e = F.col("event_type")
    seen = t(spark, d, "events").select(
        F.col("user_id").alias("company_key"), F.when(e == "view", "").otherwise("ashby").alias("ats_provider"), F.concat(F.lit("seen"), F.col("user_id").cast("string")).alias("display_domain"), e.alias("name"),
        F.when(e == "click", "").otherwise("jsonld").alias("name_source"), F.struct("ts", "event_id").alias("seq"))
    return ingest.sight_companies(old, seen, _ts(NOW))


def _pages(spark, d):
    o = t(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("company_id"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"), F.lower("o_orderpriority").alias("politeness_domain"), F.col("o_orderdate").alias("first_seen"),
        F.col("o_orderdate").alias("last_seen"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("consecutive_failures"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("last_ok"), "o_orderstatus", "o_totalprice")


PAGES = """pg AS (SELECT o_custkey AS company_id, 'u' || o_orderkey AS url, lower(o_orderpriority) AS politeness_domain, o_orderdate AS first_seen, o_orderdate AS last_seen,
  CAST(left(o_orderpriority, 1) AS INT) AS consecutive_failures, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS last_ok, o_orderstatus, o_totalprice FROM orders)"""


@query(f"""WITH {PAGES}, o AS (SELECT * FROM pg WHERE o_orderstatus <> 'P'), s AS (SELECT * FROM pg WHERE o_totalprice < 100000)
SELECT coalesce(o.company_id, s.company_id) AS company_id, coalesce(o.url, s.url) AS url, CASE WHEN s.url IS NULL THEN o.politeness_domain ELSE 'new' END AS politeness_domain, CASE WHEN o.url IS NULL THEN TIMESTAMP '{NOW}' ELSE o.first_seen END AS first_seen,
  CASE WHEN s.url IS NULL THEN o.last_seen ELSE TIMESTAMP '{NOW}' END AS last_seen, CASE WHEN s.url IS NULL THEN o.consecutive_failures ELSE 0 END AS consecutive_failures,
  CASE WHEN s.url IS NULL THEN o.last_ok WHEN o.url IS NOT NULL THEN TIMESTAMP '{NOW}' END AS last_ok FROM o FULL JOIN s ON o.url = s.url AND o.company_id = s.company_id""")
def page_sightings(spark, d):
    pages = _pages(spark, d)
    seen = pages.filter("o_totalprice < 100000").select("company_id", "url", F.lit("new").alias("politeness_domain"))
    return ingest.sight_pages(pages.filter("o_orderstatus <> 'P'").drop("o_orderstatus", "o_totalprice"), seen, _ts(NOW))


@query(f"""WITH {PAGES}, o AS (SELECT * FROM pg WHERE o_orderstatus <> 'P'),
s AS (SELECT *, CASE WHEN o_totalprice < 50000 THEN NULL ELSE first_seen - INTERVAL 3 DAY END AS f, CASE WHEN o_totalprice > 90000 THEN NULL ELSE last_seen - INTERVAL 5 DAY END AS l FROM pg WHERE o_totalprice < 100000)
SELECT coalesce(o.company_id, s.company_id) AS company_id, coalesce(o.url, s.url) AS url, CASE WHEN s.url IS NULL THEN o.politeness_domain ELSE 'new' END AS politeness_domain,
  CASE WHEN s.url IS NULL THEN o.first_seen WHEN o.url IS NOT NULL THEN least(o.first_seen, f) ELSE least(coalesce(f, TIMESTAMP '{NOW}'), coalesce(l, TIMESTAMP '{NOW}')) END AS first_seen,
  CASE WHEN s.url IS NULL THEN o.last_seen WHEN o.url IS NOT NULL THEN greatest(o.last_seen, l) ELSE coalesce(l, TIMESTAMP '{NOW}') END AS last_seen,
  CASE WHEN o.url IS NULL THEN 0 ELSE o.consecutive_failures END AS consecutive_failures, o.last_ok AS last_ok FROM o FULL JOIN s ON o.url = s.url AND o.company_id = s.company_id""")
def page_import(spark, d):
    pages = _pages(spark, d)
    day = lambda c, n: F.col(c) - F.make_dt_interval(days=F.lit(n))
    file = pages.filter("o_totalprice < 100000").select(
        "company_id", "url", F.lit("new").alias("politeness_domain"), F.when(F.col("o_totalprice") >= 50000, day("first_seen", 3)).alias("first_seen"), F.when(F.col("o_totalprice") <= 90000, day("last_seen", 5)).alias("last_seen"))
    return ingest.merge_pages(pages.filter("o_orderstatus <> 'P'").drop("o_orderstatus", "o_totalprice"), file, _ts(NOW))


@query("""WITH pg AS (SELECT l_suppkey * 10000000 + l_partkey AS page_id, l_suppkey AS company_id, 'u' || l_partkey AS url, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL),
w AS (SELECT page_id, url, 1 AS target FROM pg WHERE l_returnflag = 'R' AND company_id <> 1),
f AS (SELECT url, min(page_id) AS page_id FROM w WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.company_id = 1 AND pg.url = w.url) GROUP BY 1)
SELECT pg.page_id, pg.url, CASE WHEN f.page_id IS NOT NULL THEN 1 ELSE company_id END AS company_id, w.page_id IS NOT NULL AND f.page_id IS NULL AS refused FROM pg LEFT JOIN f ON f.page_id = pg.page_id LEFT JOIN w ON w.page_id = pg.page_id""")
def page_moves(spark, d):
    li = t(spark, d, "lineitem")
    one = li.groupBy("l_suppkey", "l_partkey").agg(F.max("l_returnflag").alias("flag"))
    pages = one.select((F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")).alias("page_id"), F.col("l_suppkey").alias("company_id"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"), "flag")
    moved, refused = ingest.reattribute_pages(pages, pages.filter("flag = 'R'").select("page_id", F.lit(1).cast("long").alias("to_company_id")))
    return moved.join(refused.select("page_id", F.lit(True).alias("r")), "page_id", "left").select("page_id", "url", "company_id", F.coalesce("r", F.lit(False)).alias("refused"))


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT (c_nationkey < 12 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus <> 'P'))")
def company_deletes(spark, d):
    companies = t(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), "c_name", "c_nationkey")
    pages = t(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("company_id"))
    return ingest.delete_companies(companies, pages, companies.filter("c_nationkey < 12")).select(F.col("company_id").alias("c_custkey"), "c_name")


SEED_SHAPES = ["https://boards.greenhouse.io/Acme", "https://jobs.lever.co/Acme/x", "https://acme.recruitee.com/o/dev", "https://www.acme.com/careers", "no url"]


@query(f"""WITH s AS (SELECT c_custkey AS k, 'own' || c_custkey AS owner, {SEED_SHAPES}[c_nationkey % 5 + 1] AS url, c_nationkey % 5 AS shape, CASE WHEN c_acctbal > 0 THEN c_custkey END AS page FROM customer WHERE c_nationkey % 5 <> 4),
b AS (SELECT *, shape IN (0, 2) AS board FROM s)
SELECT lane, url, ['greenhouse:acme', 'lever:acme', 'recruitee:acme', 'acme.com'][shape + 1] AS scope, owner, CASE WHEN lane = 'board' THEN ['greenhouse', '', 'recruitee'][shape + 1] END AS provider, CASE WHEN lane = 'board' THEN 'acme' END AS tenant, page AS career_page_id
FROM b, (SELECT unnest(['board', 'crawl', 'refetch']) AS lane) WHERE (lane = 'board' AND board) OR (lane = 'crawl' AND NOT board) OR (lane = 'refetch' AND NOT board AND page IS NOT NULL)""")
def seed_routes(spark, d):
    """Pages and pageless companies together; boards of greenhouse and recruitee have a fetcher."""
    c = t(spark, d, "customer")
    url = F.element_at(F.array(*map(F.lit, SEED_SHAPES)), (F.col("c_nationkey") % 5 + 1).cast("int"))
    owner = F.concat(F.lit("own"), F.col("c_custkey").cast("string"))
    pages = c.filter("c_acctbal > 0").select(url.alias("url"), owner.alias("company_key"), F.col("c_custkey").alias("career_page_id"))
    pageless = c.filter("NOT c_acctbal > 0").select(url.alias("url"), owner.alias("company_key"), F.lit(None).cast("long").alias("career_page_id"))
    return ingest.route_seeds(pages.unionByName(pageless), ["greenhouse", "recruitee"])


@query("SELECT provider, tenant, min(k) AS seq FROM (SELECT p_type AS provider, p_brand AS tenant, p_partkey AS k FROM part) GROUP BY ALL")
def tenant_tasks(spark, d):
    return ingest.one_task_per_tenant(t(spark, d, "part").select(F.col("p_type").alias("provider"), F.col("p_brand").alias("tenant"), F.col("p_partkey").alias("seq")))


@query(f"""WITH old AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'https://x.org/' || l_orderkey ELSE 'lever:t' || l_suppkey || ':' || l_orderkey || '-' || l_linenumber END AS u, l_suppkey AS page, l_shipdate AS seen FROM lineitem WHERE l_returnflag <> 'A'),
task AS (SELECT s_suppkey AS page, CASE WHEN s_nationkey < 5 THEN 404 WHEN s_nationkey < 10 THEN 500 ELSE 200 END AS status, s_nationkey < 18 AS complete FROM supplier),
feed AS (SELECT CASE WHEN l_linenumber = 1 THEN 'https://x.org/' || l_orderkey ELSE 'lever:t' || l_suppkey || ':' || l_orderkey || '-' || l_linenumber END AS u, l_suppkey AS page FROM lineitem JOIN task ON page = l_suppkey WHERE status = 200 AND l_returnflag <> 'R'
  QUALIFY row_number() OVER (PARTITION BY u ORDER BY l_suppkey DESC, l_partkey DESC) = 1),
o AS (SELECT u, arg_min(page, (seen, page)) AS page, min(seen) AS seen FROM old GROUP BY 1),
m AS (SELECT coalesce(o.u, f.u) AS u, coalesce(f.page, o.page) AS page, f.u IS NOT NULL AS fresh, o.seen FROM o FULL JOIN feed f ON o.u = f.u)
SELECT u AS canonical_url, m.page AS career_page_id, fresh AND true AS fresh, CASE WHEN NOT fresh AND status = 200 AND complete THEN TIMESTAMP '{NOW}' END AS closed_at,
  CASE WHEN fresh THEN CASE WHEN nation.n_regionkey = 1 THEN 'DE' WHEN nation.n_regionkey = 2 THEN 'CA' ELSE '' END ELSE 'old' END AS country, CASE WHEN fresh THEN 'co' || m.page ELSE 'old' END AS company
FROM m LEFT JOIN task ON task.page = m.page LEFT JOIN supplier ON s_suppkey = m.page LEFT JOIN nation ON n_nationkey = s_nationkey""")
def board_ingest(spark, d):
    """Lines as listings of boards; suppliers as boards that answered, failed, or were cut short."""
    li, sup = t(spark, d, "lineitem"), t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    tenant = F.concat(F.lit("t"), F.col("s_suppkey").cast("string"))
    tasks = sup.select(F.lit("lever").alias("provider"), tenant.alias("tenant"), tenant.alias("owner"), F.col("s_suppkey").alias("career_page_id"))
    status = F.when(F.col("s_nationkey") < 5, 404).when(F.col("s_nationkey") < 10, 500).otherwise(200)
    boards = sup.select(F.lit("lever").alias("provider"), tenant.alias("tenant"), status.alias("status"), (F.col("s_nationkey") < 18).alias("complete"))
    own = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    url = F.concat(F.lit("http://www.x.org/"), F.col("l_orderkey").cast("string"), F.lit("/?utm_source=a"))
    region = F.col("n_regionkey")
    feed = li.filter("l_returnflag <> 'R'").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).filter(status == 200).select(
        F.lit("lever").alias("provider"), tenant.alias("tenant"), F.when(F.col("l_linenumber") == 1, "").otherwise(own).alias("source_id"), url.alias("url"),
        F.concat(F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.lit("-"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("seq_"), F.lit("title").alias("title"), F.when(region == 1, "Berlin").when(region == 2, "Berlin").otherwise("nowhere").alias("location"),
        F.when(region == 2, "ca").when(region == 1, "zz").otherwise("").alias("country_hint"), F.lit("").alias("department"), F.lit("remote").alias("work_arrangement"), F.lit("body").alias("body"))
    gaz = spark.createDataFrame(geo.GAZETTEER, "layer string, phrase string, code string")
    places = feed.select("location").union(feed.select("country_hint")).distinct()
    companies = sup.select(tenant.alias("company_key"), F.concat(F.lit("co"), F.col("s_suppkey").cast("string")).alias("name"))
    # The last posting of a URL holds; the feed has one row of each.
    found = ingest.board_listings(tasks, feed.withColumn("title", F.col("seq_")), companies, geo.resolve(places, gaz), geo.iso_codes(spark))
    found = found.groupBy("canonical_url").agg(F.max(F.struct("title", *[c for c in found.columns if c not in ("canonical_url", "title")])).alias("x")).select("canonical_url", "x.*").select(found.columns)
    old_key = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("https://x.org/"), F.col("l_orderkey").cast("string"))).otherwise(F.concat(F.lit("lever:t"), F.col("l_suppkey").cast("string"), F.lit(":"), own))
    old = li.filter("l_returnflag <> 'A'").groupBy(old_key.alias("canonical_url")).agg(F.min_by("l_suppkey", F.struct("l_shipdate", "l_suppkey")).alias("career_page_id"), F.min("l_shipdate").alias("seen"))
    said = lambda *names: [F.lit("old").alias(n) for n in names]
    listings = old.select(
        "canonical_url", F.lit("u").alias("url"), F.lit("ats").alias("source"), "career_page_id", *said("company", "company_key", "title", "description", "description_source", "location", "country", "work_arrangement", "department"),
        F.lit(None).cast("int").alias("discovered_depth"), F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"), F.lit(None).cast("timestamp").alias("closed_at"), F.lit(0).alias("inconclusive_streak"))
    after, _ = ingest.ingest_boards(listings, tasks, found, boards, _ts(NOW), _ts(NOW))
    return after.select("canonical_url", "career_page_id", (F.col("last_seen") == _ts(NOW)).alias("fresh"), "closed_at", "country", "company")


@query("""SELECT s_suppkey AS page_id, CASE WHEN s_nationkey < 5 THEN 'dead' WHEN s_nationkey < 10 THEN 'inconclusive' ELSE 'alive' END AS outcome FROM supplier""")
def board_probes(spark, d):
    s = t(spark, d, "supplier")
    tasks = s.select(F.lit("x").alias("provider"), F.col("s_suppkey").alias("tenant"), F.col("s_suppkey").alias("career_page_id"))
    boards = s.select(F.lit("x").alias("provider"), F.col("s_suppkey").alias("tenant"), F.when(F.col("s_nationkey") < 5, 404).when(F.col("s_nationkey") < 10, 500).otherwise(200).alias("status"))
    return tasks.join(boards, ["provider", "tenant"]).select(F.col("career_page_id").alias("page_id"), ingest.fetch_outcome(F.col("status")).alias("outcome"))


LISTED = """li AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS page, CASE WHEN l_linenumber = 7 THEN 'https://x.org/jobs/' ELSE 'https://x.org/jobs/dev-' || l_orderkey END AS url, l_linenumber, l_quantity AS q, l_shipdate AS seen,
  CASE WHEN l_returnflag = 'A' THEN l_shipdate END AS closed, CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END AS streak, CASE WHEN l_tax > 0.05 THEN 'llm_summary' ELSE 'page_content' END AS src
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)"""
REFETCHED = f"""{LISTED}, pg AS (SELECT s_suppkey AS page, s_nationkey AS n, s_nationkey % 6 AS failures, CASE WHEN s_nationkey < 4 THEN 404 WHEN s_nationkey < 6 THEN 503 ELSE 200 END AS status, CASE WHEN s_nationkey < 8 THEN NULL ELSE s_nationkey < 16 END AS still FROM supplier),
pp AS (SELECT *, CASE WHEN status = 404 THEN 'dead' WHEN status <> 200 OR still IS NULL THEN 'inconclusive' WHEN still THEN 'alive' ELSE 'dead' END AS o FROM pg),
pa AS (SELECT *, CASE o WHEN 'alive' THEN 0 WHEN 'dead' THEN failures + 1 ELSE failures END AS after FROM pp),
x AS (SELECT li.*, failures < 5 AND after >= 5 AS sleeps, CASE WHEN l_linenumber = 7 THEN 'dead' WHEN q <= 5 THEN 'dead' WHEN q <= 10 THEN 'inconclusive' WHEN q <= 15 THEN 'inconclusive' WHEN q <= 30 THEN 'alive' END AS lo FROM li JOIN pa ON pa.page = li.page),
y AS (SELECT *, closed IS NULL AND NOT sleeps AS due FROM x)"""


@query(f"""WITH {REFETCHED}
SELECT id AS canonical_url, CASE WHEN due AND lo = 'alive' THEN TIMESTAMP '{NOW}' ELSE seen END AS last_seen,
  CASE WHEN closed IS NOT NULL THEN closed WHEN sleeps THEN TIMESTAMP '{NOW}' WHEN lo = 'dead' OR (lo = 'inconclusive' AND streak + 1 >= 3) THEN TIMESTAMP '{NOW}' END AS closed_at,
  CASE WHEN NOT due OR lo IS NULL THEN streak WHEN lo = 'inconclusive' THEN streak + 1 ELSE 0 END AS inconclusive_streak,
  CASE WHEN due AND lo = 'alive' AND src = 'llm_summary' AND q > 18 THEN 'page_content' ELSE src END AS description_source FROM y""")
def refetched_listings(spark, d):
    return _refetch(spark, d)[1].select("canonical_url", "last_seen", "closed_at", "inconclusive_streak", "description_source")


@query(f"WITH {REFETCHED} SELECT id AS canonical_url FROM y WHERE due AND lo IS NULL AND q <= 45")
def refetched_again(spark, d):
    return _refetch(spark, d)[2].select("canonical_url")


@query(f"WITH {REFETCHED} SELECT page AS page_id, after AS consecutive_failures, CASE WHEN o = 'alive' THEN TIMESTAMP '{NOW}' END AS last_ok FROM pa")
def refetched_pages(spark, d):
    return _refetch(spark, d)[0]


def _refetch(spark, d):
    n = F.col("s_nationkey")
    sup = t(spark, d, "supplier")
    pages = sup.select(F.col("s_suppkey").alias("page_id"), (n % 6).alias("consecutive_failures"), F.lit(None).cast("timestamp").alias("last_ok"))
    fetched_pages = sup.select(F.col("s_suppkey").alias("page_id"), F.when(n < 4, 404).when(n < 6, 503).otherwise(200).alias("status"), F.when(n >= 8, n < 16).alias("still_career_page"))
    rest = ["l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    li, q = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*rest)).alias("x")).select("l_orderkey", "l_linenumber", "x.*"), F.col("l_quantity")
    url = F.when(F.col("l_linenumber") == 7, "https://x.org/jobs/").otherwise(F.concat(F.lit("https://x.org/jobs/dev-"), F.col("l_orderkey").cast("string")))
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("canonical_url")
    listings = li.select(
        key, url.alias("url"), F.col("l_suppkey").alias("career_page_id"), F.lit("h").alias("source_hash"), F.lit("old").alias("description"), F.when(F.col("l_tax") > 0.05, "llm_summary").otherwise("page_content").alias("description_source"),
        F.col("l_shipdate").alias("last_seen"), F.when(F.col("l_returnflag") == "A", F.col("l_shipdate")).alias("closed_at"), F.when(F.col("l_linestatus") == "O", 2).otherwise(0).alias("inconclusive_streak"))
    fetched = li.select(
        key, F.when(q <= 5, 410).when(q <= 10, 503).otherwise(200).alias("status"), (q > 15).alias("parsed"), F.when(q <= 30, "h").otherwise("other").alias("source_hash"), (q <= 45).alias("extractable"),
        F.when(q > 18, "the page").otherwise("").alias("body"), F.lit("page_content").alias("body_source"))
    return ingest.refetch(pages, fetched_pages, listings, fetched, _ts(NOW))


@query("SELECT DISTINCT 'https://x.org/jobs/dev-' || l_orderkey AS url FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag <> 'A' AND s_nationkey < 12")
def visited_seeds(spark, d):
    li = t(spark, d, "lineitem").select(F.concat(F.lit("https://x.org/jobs/dev-"), F.col("l_orderkey").cast("string")).alias("url"), F.col("l_suppkey").alias("career_page_id"), F.when(F.col("l_returnflag") == "A", F.col("l_shipdate")).alias("closed_at"))
    return ingest.seed_visited(li, t(spark, d, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("career_page_id")))


@query("""WITH s AS (SELECT 'u' || l_partkey AS url, min(l_orderkey) AS seq FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), n AS (SELECT 'u' || l_partkey AS url, min(l_orderkey) AS seq FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT url, seq FROM (SELECT * FROM s UNION ALL SELECT * FROM n WHERE url NOT IN (SELECT url FROM s)) ORDER BY seq DESC, url DESC LIMIT 150""")
def visited_marks(spark, d):
    u = t(spark, d, "lineitem").select(F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"), F.col("l_orderkey").alias("seq"), "l_returnflag")
    seen = u.filter("l_returnflag = 'N'").groupBy("url").agg(F.min("seq").alias("seq"))
    return frontier.mark_visited(seen, u.filter("l_returnflag <> 'N'").select("url", "seq"), 150)


@query("SELECT host, count(*) AS length FROM (SELECT l_suppkey AS host, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A' AND NOT (l_returnflag = 'R' AND l_linestatus = 'F')) GROUP BY 1")
def frontier_length(spark, d):
    li = t(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("url"), F.col("l_suppkey").alias("host"), "l_returnflag", "l_linestatus")
    leases = li.filter("l_returnflag = 'R'")
    return frontier.length(li.filter("l_returnflag = 'N'"), frontier.mark_done(leases, leases.filter("l_linestatus = 'F'")))


@query("""WITH r AS (SELECT o_custkey AS run, 'q' AS part, o_orderkey AS url FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 'l', o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT part, count(*) AS n FROM r WHERE run <> 7 GROUP BY 1""")
def frontier_delete_run(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("url"), "o_orderstatus")
    queue, leases = frontier.delete_run([o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'")], 7)
    both = queue.withColumn("part", F.lit("q")).unionByName(leases.withColumn("part", F.lit("l")))
    return both.groupBy("part").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT p_partkey, CASE WHEN p_size <= 15 THEN 'url' WHEN p_size <= 30 THEN 'wait' ELSE 'done' END AS verdict FROM part) SELECT p_partkey, verdict = 'done' AS bounded, false AS perpetual FROM v""")
def walk_ends(spark, d):
    v = F.when(F.col("p_size") <= 15, "url").when(F.col("p_size") <= 30, "wait").otherwise("done")
    return t(spark, d, "part").select("p_partkey", frontier.ends(v, False).alias("bounded"), frontier.ends(v, True).alias("perpetual"))


@query(f"""WITH r AS (SELECT o_orderkey AS run_id, 'd' || o_custkey AS definition, CASE WHEN o_orderstatus = 'P' THEN 'running' ELSE 'finished' END AS status, o_orderdate AS started_at FROM orders),
c AS (SELECT count(*) FILTER (WHERE status = 'running') AS active, max(started_at) AS last FROM r WHERE definition = 'd1')
SELECT '' || run_id AS run_id, definition, status, started_at FROM r UNION ALL SELECT 'new', 'd1', 'running', TIMESTAMP '{NOW}' FROM c WHERE active = 0 AND (last IS NULL OR TIMESTAMP '{NOW}' >= last + INTERVAL 1 DAY)""")
def cycle_start(spark, d):
    runs = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("definition"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("finished").alias("status"), F.col("o_orderdate").alias("started_at"))
    return frontier.start_cycle(runs, "d1", "new", _ts(NOW), 86_400)


# --- work -----------------------------------------------------------------------------------

WORK = "w AS (SELECT p_partkey AS id, p_name AS payload, CAST(p_size % 4 AS INT) AS attempts, CASE WHEN p_size > 20 THEN TIMESTAMP '2024-05-31 23:59:00' - to_seconds(CAST(p_size AS INT)) * 2 END AS delivered_at, p_size FROM part)"


def _work(spark, d):
    size = F.col("p_size")
    delivered = F.when(size > 20, _ts("2024-05-31 23:59:00") - F.make_dt_interval(secs=size * 2))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("payload"), (size % 4).cast("int").alias("attempts"), delivered.alias("delivered_at"), "p_size")


@query("""WITH b AS (SELECT p_partkey AS id FROM part WHERE p_size > 10), n AS (SELECT p_partkey AS id, p_name FROM part WHERE p_size <= 10 ORDER BY 1 LIMIT 20)
SELECT id, true AS taken FROM b UNION ALL SELECT id, true FROM n UNION ALL SELECT p_partkey, false FROM part WHERE p_size <= 10 AND p_partkey NOT IN (SELECT id FROM n)""")
def work_backlog(spark, d):
    w = _work(spark, d)
    old, new = w.filter("p_size > 10").drop("p_size"), w.filter("p_size <= 10").select("id", "payload")
    after, refused = work.submit(old, new.unionByName(new), old.count() + 20)
    return after.select("id", F.lit(True).alias("taken")).unionByName(refused.select("id", F.lit(False).alias("taken")))


@query(f"""WITH {WORK}, g AS (SELECT id FROM w WHERE delivered_at IS NULL OR delivered_at <= TIMESTAMP '2024-06-01' - INTERVAL 120 SECOND ORDER BY id LIMIT 50)
SELECT w.id, attempts + 1 AS attempts FROM w JOIN g USING (id)""")
def work_delivery(spark, d):
    return work.deliver(_work(spark, d).drop("p_size"), _ts(NOW), 50, 120)[1].select("id", "attempts")


@query(f"""WITH {WORK} SELECT id, CASE WHEN p_size > 25 THEN 'waits' WHEN p_size > 12 THEN 'done' WHEN attempts >= 3 THEN 'dead' ELSE 'waits' END AS fate FROM w WHERE p_size > 25 OR p_size <= 12""")
def work_settlement(spark, d):
    w = _work(spark, d)
    outcomes = w.filter("p_size <= 25").select("id", (F.col("p_size") > 12).alias("ok"))
    left, dead = work.settle(w.drop("p_size"), outcomes, w.limit(0).select("id", "payload", "attempts", _ts(NOW).alias("dead_at")), _ts(NOW))
    return left.select("id", F.lit("waits").alias("fate")).unionByName(dead.select("id", F.lit("dead").alias("fate")))


@query("""SELECT event_type AS rung, count(*) FILTER (WHERE value > 60) AS accepts, count(*) FILTER (WHERE value <= 60 AND value > 10) AS abstains, count(*) FILTER (WHERE value <= 10) AS errors,
  CASE WHEN count(*) FILTER (WHERE value > 10) = 0 THEN 0 ELSE round(count(*) FILTER (WHERE value > 60) / count(*) FILTER (WHERE value > 10), 4) END AS false_drop_rate FROM events GROUP BY 1""")
def shadow_tallies(spark, d):
    v = F.col("value")
    return work.shadow_tallies(t(spark, d, "events").select(F.col("event_type").alias("rung"), F.when(v > 60, "accept").when(v > 10, "abstain").otherwise("error").alias("verdict")))


# --- jobs, runs, searches -------------------------------------------------------------------


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderstatus IN ('O', 'P') THEN TIMESTAMP '{NOW}' ELSE o_orderdate END AS finished_at FROM orders")
def interrupted_jobs(spark, d):
    s = F.col("o_orderstatus")
    jobs = t(spark, d, "orders").select("o_orderkey", F.when(s == "O", "running").when(s == "P", "pending").otherwise("done").alias("status"), F.when(s == "F", F.col("o_orderdate")).alias("finished_at"))
    return edits.sweep_interrupted(jobs, _ts(NOW))


@query("SELECT p_brand AS key, CASE WHEN p_brand = 'Brand#1' AND count(*) FILTER (WHERE p_type = 'PROMO') = 0 THEN array_to_string(list_sort(list_distinct(list(p_type))), ',') || ',PROMO' ELSE array_to_string(list_sort(list_distinct(list(p_type))), ',') END AS seeds FROM part GROUP BY 1")
def seed_append(spark, d):
    defs = t(spark, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.array_sort(F.collect_set("p_type")).alias("seed_urls"))
    return edits.append_seed(defs, "Brand#1", "PROMO").select("key", F.array_join("seed_urls", ",").alias("seeds"))


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey < 9 THEN 'renamed ' || c_custkey ELSE c_name END AS name FROM customer")
def search_renames(spark, d):
    c = t(spark, d, "customer")
    names = c.filter("c_nationkey < 9").select(F.col("c_custkey").alias("id"), F.concat(F.lit("renamed "), F.col("c_custkey").cast("string")).alias("name")).unionByName(spark.range(1).select((F.col("id") - 5).alias("id"), F.lit("unknown").alias("name")))
    return edits.rename_searches(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), names)


@query(f"""WITH r AS (SELECT o_orderkey AS run_id, o_custkey AS definition, CASE WHEN o_orderstatus = 'P' THEN 'paused' ELSE 'finished' END AS status FROM orders),
n AS (SELECT c_custkey AS definition FROM customer WHERE c_nationkey < 12 AND c_custkey NOT IN (SELECT definition FROM r WHERE status = 'paused'))
SELECT run_id, definition, status FROM r UNION ALL SELECT -definition, definition, 'running' FROM n""")
def run_starts(spark, d):
    runs = t(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("definition"), F.when(F.col("o_orderstatus") == "P", "paused").otherwise("finished").alias("status"), F.col("o_orderdate").alias("started_at"))
    k = F.col("c_custkey")
    wanted = t(spark, d, "customer").filter("c_nationkey < 12").select((-k).alias("run_id"), k.alias("definition"))
    return edits.start_runs(runs, wanted.unionByName(wanted.withColumn("run_id", F.lit(0).cast("long") - F.col("definition") + 0)), _ts(NOW)).drop("started_at")
