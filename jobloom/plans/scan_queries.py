"""Queries of plain scans, catalog views, capture and gold files, robots rules, model answers, GeoNames files and text
signals, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import geo, rendering, text, urls
from jobloom.operators import frontier, gate, scans, search
from jobloom.plans.registered import _ts, _values, corpus, query, t
from jobloom.sources import captures, geonames, postings, robots

# --- scans ----------------------------------------------------------------------------------

SEEN = "(SELECT o_custkey AS k, max(o_orderdate) AS last_seen FROM orders GROUP BY 1)"


@query(f"SELECT c_custkey, c_name, last_seen FROM customer JOIN {SEEN} ON k = c_custkey ORDER BY last_seen DESC, c_custkey")
def companies_scan(spark, d):
    seen = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_seen"))
    return scans.newest_first(t(spark, d, "customer").select("c_custkey", "c_name").join(seen, "c_custkey"), "last_seen", "c_custkey")


@query("SELECT o_orderkey, o_custkey, o_orderdate AS last_seen, CAST(left(o_orderpriority, 1) AS INT) AS consecutive_failures FROM orders ORDER BY last_seen DESC, o_orderkey")
def career_pages_scan(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("last_seen"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("consecutive_failures"))
    return scans.newest_first(o, "last_seen", "o_orderkey")


@query("SELECT o_orderkey AS run_id, o_orderstatus AS status, o_orderdate AS started_at FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY started_at DESC, run_id")
def runs_by_status(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"))
    return scans.newest_first(scans.by_keys(o, "status", ["O", "P"]), "started_at", "run_id")


@query("SELECT o_orderkey AS run_id, o_orderstatus AS status FROM orders WHERE o_orderkey = 5")
def run_by_id(spark, d):
    return scans.by_keys(t(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status")), "run_id", [5])


@query("SELECT p_partkey AS id, p_name AS name, TIMESTAMP '2024-01-01' + to_days(CAST(p_size AS INT)) AS created_at FROM part ORDER BY created_at DESC, id")
def definitions_scan(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (_ts("2024-01-01") + F.make_dt_interval(days=F.col("p_size"))).alias("created_at"))
    return scans.newest_first(p, "created_at", "id")


@query("SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN '' ELSE 'key' || p_partkey END AS idempotency_key, TIMESTAMP '2024-01-01' + to_days(CAST(p_size AS INT)) AS created_at FROM part ORDER BY created_at DESC, id")
def import_jobs_scan(spark, d):
    key = F.when(F.col("p_size") >= 10, F.concat(F.lit("key"), F.col("p_partkey").cast("string")))
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.coalesce(key, F.lit("")).alias("idempotency_key"), (_ts("2024-01-01") + F.make_dt_interval(days=F.col("p_size"))).alias("created_at"))
    return scans.newest_first(p, "created_at", "id")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size >= 10 AND 'key' || p_partkey = 'key7'")
def import_job_by_key(spark, d):
    p = t(spark, d, "part").filter("p_size >= 10").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("key"), F.col("p_partkey").cast("string")).alias("k"))
    return scans.by_keys(p, "k", ["key7"]).drop("k")


@query("SELECT p_partkey AS id, p_name AS name, list_sort([p_type, p_brand]) AS countries, TIMESTAMP '2024-01-01' + to_days(CAST(p_size AS INT)) AS created_at FROM part ORDER BY created_at, id".replace("list_sort([p_type, p_brand])", "p_type || ',' || p_brand"))
def saved_searches_scan(spark, d):
    facets = F.array_join(F.array("p_type", "p_brand"), ",")
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), facets.alias("countries"), (_ts("2024-01-01") + F.make_dt_interval(days=F.col("p_size"))).alias("created_at"))
    return scans.oldest_first(p, "created_at", "id")


@query("SELECT l_orderkey AS canonical_url, l_suppkey AS career_page_id, l_shipdate AS first_seen FROM lineitem WHERE l_suppkey = 3 AND l_returnflag <> 'A' ORDER BY first_seen, canonical_url")
def page_open_listings(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("canonical_url"), F.col("l_suppkey").alias("career_page_id"), F.col("l_shipdate").alias("first_seen"), F.lit("long").alias("description"), F.when(F.col("l_returnflag") == "A", F.col("l_shipdate")).alias("closed_at"))
    return scans.open_listings(li, 3).drop("closed_at")


VIEW = """c AS (SELECT c_custkey AS company_key, CASE WHEN c_nationkey < 5 THEN '' WHEN c_nationkey < 10 THEN 'Ärger ' || c_custkey ELSE c_name END AS name, 'domain' || c_custkey || '.org' AS display_domain,
  CASE WHEN c_acctbal > 0 THEN 'lever' END AS ats_provider, CASE WHEN c_mktsegment = 'BUILDING' THEN 'jsonld' WHEN c_mktsegment = 'MACHINERY' THEN 'title' END AS name_source FROM customer)"""


def _companies(spark, d):
    n, text_ = F.col("c_nationkey"), F.col("c_custkey").cast("string")
    return t(spark, d, "customer").select(
        F.col("c_custkey").alias("company_key"), F.when(n < 5, "").when(n < 10, F.concat(F.lit("Ärger "), text_)).otherwise(F.col("c_name")).alias("name"), F.concat(F.lit("domain"), text_, F.lit(".org")).alias("display_domain"),
        F.when(F.col("c_acctbal") > 0, "lever").alias("ats_provider"), F.when(F.col("c_mktsegment") == "BUILDING", "jsonld").when(F.col("c_mktsegment") == "MACHINERY", "title").alias("name_source"))


@query(f"WITH {VIEW} SELECT company_key, name, display_domain FROM c WHERE ats_provider = 'lever' AND coalesce(name_source, '') NOT IN ('jsonld', 'meta') AND name LIKE 'Ärger%'")
def catalog_view(spark, d):
    return scans.catalog_view(_companies(spark, d), "ats", True, "A").select("company_key", "name", "display_domain")


@query(f"WITH {VIEW} SELECT company_key, name FROM c WHERE ats_provider IS NULL")
def catalog_view_self(spark, d):
    """A letter that no company of the view has shows them all."""
    return scans.catalog_view(_companies(spark, d), "self", False, "Q").select("company_key", "name")


@query(f"WITH {VIEW} SELECT company_key, row_number() OVER (ORDER BY replace(lower(CASE WHEN name = '' THEN display_domain ELSE name END), 'ä', 'a'), company_key) AS place FROM c")
def companies_by_name(spark, d):
    from pyspark.sql import Window

    # The place of each in the order; one window over the catalog, to make the order itself visible.
    shown = F.collate(F.coalesce(F.nullif("name", F.lit("")), "display_domain"), "UNICODE_CI_AI")
    return scans.by_name(_companies(spark, d)).select("company_key", F.row_number().over(Window.orderBy(shown, "company_key")).cast("long").alias("place"))


# --- captures, answers, robots, GeoNames ----------------------------------------------------


@query("""WITH c AS (SELECT 'https://x.org/' || user_id AS url, event_type <> 'error' AS verdict, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, event_id AS line, event_type, value FROM events WHERE event_type <> 'signup')
SELECT url, arg_max(line, (ts, line)) AS seq, arg_max(verdict, (ts, line)) AS verdict, count(*) AS n FROM c WHERE NOT (event_type = 'click' AND value > 50) GROUP BY 1""")
def capture_scan(spark, d):
    """Events as captured lines; some have no http URL, and some are cut off."""
    e = t(spark, d, "events")
    url = F.when(F.col("event_type") == "signup", "ftp:nowhere").otherwise(F.concat(F.lit("https://x.org/"), F.col("user_id").cast("string")))
    raw = F.to_json(F.struct(url.alias("url"), (F.col("event_type") != "error").alias("verdict"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit("r").alias("renderer")))
    cut = F.when((F.col("event_type") == "click") & (F.col("value") > 50), F.left(raw, F.lit(20))).otherwise(raw)
    return captures.scan_captures(e.select(F.col("event_id").alias("line"), cut.alias("raw"))).select("url", "seq", "verdict", F.size("timeline").cast("long").alias("n"))


@query("SELECT event_id, event_type <> 'error' AS verdict FROM events WHERE value > 20 QUALIFY row_number() OVER (PARTITION BY event_type <> 'error' ORDER BY event_id) <= 40")
def capture_cap(spark, d):
    e = t(spark, d, "events").select("event_id", (F.col("event_type") != "error").alias("verdict"), F.when(F.col("value") > 20, "r").otherwise("").alias("renderer"))
    return captures.capped(e, "event_id", 40).drop("renderer")


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2', 'src3') THEN '{\"n\":' || n_chars || ',\"o\":{\"a\":1}}' END AS json FROM documents")
def model_answers(spark, d):
    body = F.concat(F.lit('{"n":'), F.col("n_chars").cast("string"), F.lit(',"o":{"a":1}}'))
    s = F.col("source")
    answer = F.when(s == "src1", F.concat(F.lit("<think>a {b}\n</think>\n```json\n"), body, F.lit("\n```"))).when(s == "src2", F.concat(F.lit("Here: "), body, F.lit(" done."))).when(s == "src3", body).when(s == "src4", F.lit("none")).otherwise(F.lit("{broken"))
    return t(spark, d, "documents").select("doc_id", postings.lenient_json(answer).alias("json"))


@query("""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS target FROM pages),
h AS (SELECT *, length(host) % 5 AS kind FROM p)
SELECT DISTINCT url, CASE kind WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NOT starts_with(target, '/en/') OR regexp_matches(target, '^/en/[0-9]+$') WHEN 3 THEN NOT regexp_matches(target, '\\?') ELSE true END AS allowed FROM h""")
def robots_allowed(spark, d):
    """Hosts without a file, with a file that fails, and with three kinds of rules, by the length of their name."""
    pages = t(spark, d, "pages").select("url", urls.host(F.col("url")).alias("host"))
    kind = F.length("host") % 5
    files = pages.select("host").distinct().select(
        "host", F.when(kind == 0, 404).when(kind == 1, 503).otherwise(200).alias("status"),
        F.when(kind == 2, "User-agent: other\nDisallow: /\n\nUser-Agent: *\nDisallow: /en/ # all\nAllow: /en/*0$\nAllow: /en/*1$\nAllow: /en/*2$\nAllow: /en/*3$\nAllow: /en/*4$\nAllow: /en/*5$\nAllow: /en/*6$\nAllow: /en/*7$\nAllow: /en/*8$\nAllow: /en/*9$")
        .when(kind == 3, "User-agent: mybot\nUser-agent: b\nDisallow: /*?\n\nUser-agent: *\nDisallow: /").otherwise("User-agent: *\nDisallow:\n").alias("body"))
    return robots.allowed(pages, robots.rules(files, "MyBot/1.0"))


@query("""SELECT c_name AS name, 'Ö' || c_name AS alias, 'N' || c_nationkey AS country, CAST(floor(abs(c_acctbal)) AS BIGINT) AS population FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def geonames_cities(spark, d):
    c = t(spark, d, "customer")
    cells = ["1", F.concat(F.lit(" Ö"), "c_name"), F.col("c_name"), "", "", "", "", "", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), "", "", "", "", "", F.floor(F.abs("c_acctbal")).cast("string"), "x"]
    line = F.concat_ws("\t", *[F.lit(x) if isinstance(x, str) else x for x in cells])
    return geonames.cities(c.select(F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("#"), line)).otherwise(line).alias("raw")))


GEO_COUNTRIES = [("DE", "Germany"), ("CH", "Switzerland"), ("US", "United States"), ("GE", "Georgia"), ("XK", "Kosovo"), ("CA", "Canada")]
GEO_STATES = [("US.CA", "California"), ("US.TX", "Texas"), ("US.OR", "Oregon"), ("US.GA", "Georgia"), ("CA.01", "Alberta")]
GEO_SYNONYMS = [("country", "Deutschland", "DE"), ("country", "USA", "US"), ("city", "Cologne", "DE"), ("city", "Texas", "DE")]
GEO_EXTRA = [("Bern", "Bern", "CH", 130_000), ("Bern", "Bern", "DE", 900), ("Europe", "Europe", "US", 10), ("Munchen", "München", "DE", 1_000_000), ("Texas", "Texas", "US", 5), ("Paris", "Paris", "US", 20_000), ("Paris", "Paris", "CA", 12_000), ("Pristina", "Pristina", "XK", 9)]


@query(f"""WITH country(code, name) AS {_values(GEO_COUNTRIES)}, syn(kind, phrase, code) AS {_values(GEO_SYNONYMS)},
ctry AS (SELECT lower(name) AS phrase, code FROM country WHERE code <> 'XK' UNION SELECT lower(phrase), code FROM syn WHERE kind = 'country'),
st AS (SELECT unnest(['tx', 'ga', 'california', 'texas', 'oregon']) AS phrase),
city AS (SELECT name, alias, country, CAST(pop AS BIGINT) AS pop FROM {_values([tuple(map(str, x)) for x in GEO_EXTRA])} v(name, alias, country, pop)
  UNION ALL SELECT 'c' || c_custkey % 97, 'c' || c_custkey % 97, ['DE', 'CH', 'US'][c_nationkey % 3 + 1], CAST(round(c_acctbal * 100) AS BIGINT) FROM customer),
keyed AS (SELECT DISTINCT k, country, pop FROM (SELECT unnest([lower(name), translate(lower(alias), 'ü', 'u')]) AS k, country, pop FROM city) WHERE country <> 'XK' AND k <> 'europe' AND k NOT IN (SELECT phrase FROM ctry) AND k NOT IN (SELECT phrase FROM st)),
m AS (SELECT k, country, max(pop) AS p FROM keyed GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY k) AS n, lead(p) OVER w AS p2 FROM m WINDOW w AS (PARTITION BY k ORDER BY p DESC, country DESC)),
lone AS (SELECT k AS phrase, country AS code FROM r WHERE i = 1 AND (n = 1 OR (p >= 100000 AND p2 > 0 AND p >= 8 * p2)))
SELECT 'country' AS layer, phrase, code FROM ctry UNION ALL SELECT 'state', phrase, 'US' FROM st UNION ALL SELECT 'city', phrase, code FROM lone WHERE phrase <> 'cologne' UNION ALL SELECT 'city', 'cologne', 'DE'""")
def gazetteer_build(spark, d):
    c = t(spark, d, "customer")
    name = F.concat(F.lit("c"), (F.col("c_custkey") % 97).cast("string"))
    country = F.element_at(F.array(*map(F.lit, ["DE", "CH", "US"])), (F.col("c_nationkey") % 3 + 1).cast("int"))
    own = c.select(name.alias("name"), name.alias("alias"), country.alias("country"), F.round(F.col("c_acctbal") * 100).cast("long").alias("population"))
    cities = spark.createDataFrame(GEO_EXTRA, "name string, alias string, country string, population long").unionByName(own)
    lines = lambda rows, at: spark.createDataFrame([("\t".join([r[0], *[""] * at, r[1]]),) for r in rows] + [("# comment",), ("",)], "raw string")
    synonyms = spark.createDataFrame(GEO_SYNONYMS, "kind string, phrase string, code string")
    return geonames.gazetteer(geonames.countries(lines(GEO_COUNTRIES, 3)), cities, geonames.us_states(lines(GEO_STATES, 0)), synonyms)


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'AT' WHEN 1 THEN 'DE' WHEN 2 THEN 'CH' ELSE 'CH' END AS country FROM nation")
def country_hints(spark, d):
    """A code, a name, two letters that are no country, and nothing."""
    k = F.col("n_nationkey") % 4
    hint = F.when(k == 0, " at").when(k == 1, "Deutschland").when(k == 2, "zz").otherwise("")
    n = t(spark, d, "nation").select("n_nationkey", hint.alias("hint"), F.lit("Bern").alias("location"))
    gaz = spark.createDataFrame(geo.GAZETTEER, "layer string, phrase string, code string")
    found = geo.resolve(n.select("location").union(n.select("hint")), gaz)
    rows = n.join(found.select("location", F.col("country").alias("by_place")), "location").join(found.select(F.col("location").alias("hint"), F.col("country").alias("by_hint")), "hint", "left")
    return rows.select("n_nationkey", geo.hinted(F.col("hint"), F.col("by_hint"), F.col("by_place"), geo.iso_codes(spark)).alias("country"))


# --- text signals ---------------------------------------------------------------------------


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)(^|[^0-9A-Za-z_])and([^0-9A-Za-z_]|$)') AS word_and, contains(lower(text), 'the ') AS part_the,
  regexp_matches(text, '(?i)(^|[^0-9A-Za-z_])and([^0-9A-Za-z_]|$)') AND contains(lower(text), 'the ') AS both, NOT contains(lower(split_part(text, chr(10), 1)), 'thi') AND NOT contains(lower(text), 'ich') AS passes FROM documents""")
def content_filters(spark, d):
    x, title = F.col("text"), F.split_part("text", F.lit("\n"), F.lit(1))
    word, part = text.contains_word(x, "and"), text.contains_text(x, "The ")
    passes = gate.chain(("block", gate.every(text.contains_text(title, "thi"))), ("block", text.contains_text(x, "ICH")), ("pass", gate.every(word, part)))
    return t(spark, d, "documents").select("doc_id", word.alias("word_and"), part.alias("part_the"), gate.every(word, part).alias("both"), passes.alias("passes"))


@query("SELECT doc_id, false AS accepted, lang = 'en' AS waved FROM documents")
def constant_filters(spark, d):
    ok = F.col("lang") == "en"
    return t(spark, d, "documents").select("doc_id", gate.chain(("block", gate.reject())).alias("accepted"), gate.chain(("pass", ok), ("block", gate.reject())).alias("waved"))


TITLES = ["Jobs at @", "Karriere bei @", "Hiring a dev (m/w/d)", "Dev gesucht ( F / M : X )", "About @", "Apply now: responsibilities, requirements, benefits, vollzeit", "Ihre Aufgaben und Ihr Profil"]


@query(f"""WITH x AS (SELECT c_custkey, replace({TITLES}[c_nationkey % 7 + 1], '@', c_name) AS t, c_nationkey % 7 AS k FROM customer)
SELECT c_custkey, k IN (0, 1) AS strong, k IN (2, 3) AS vacancy, k = 5 AS applies, k IN (2, 3) AS designation, CASE k WHEN 5 THEN 4 WHEN 6 THEN 2 ELSE 0 END AS groups FROM x""")
def title_signals(spark, d):
    n = F.col("c_nationkey") % 7
    title = F.replace(F.element_at(F.array(*map(F.lit, TITLES)), (n + 1).cast("int")), F.lit("@"), F.col("c_name"))
    low = F.lower(title)
    return t(spark, d, "customer").select(
        "c_custkey", gate.strong_title(title).alias("strong"), gate.title_announces_vacancy(title).alias("vacancy"), gate.apply_affordance(low).alias("applies"), gate.role_designation(title).alias("designation"),
        text.vocabulary_groups(low).alias("groups"))


@query(r"""WITH x AS (SELECT p_partkey, ['Remote', 'on-site', 'ON SITE', 'Hybrid', 'hy_brid', 'moon'][p_size % 6 + 1] AS a, ['Örtel', '3M', ' acme', 'Élan', '', 'ßx'][p_size % 6 + 1] AS n, p_size * p_size * 7919 AS s FROM part)
SELECT p_partkey, ['remote', 'onsite', 'onsite', 'hybrid', 'hybrid', 'unspecified'][CAST(p_partkey AS INT) * 0 + list_position(['Remote', 'on-site', 'ON SITE', 'Hybrid', 'hy_brid', 'moon'], a)] AS arrangement,
  CASE n WHEN 'Örtel' THEN 'O' WHEN ' acme' THEN 'A' WHEN 'Élan' THEN 'E' WHEN 'ßx' THEN 'S' ELSE '0-9' END AS initial, 'lever:acme:' || p_partkey AS listing_id,
  CASE WHEN s < 5 THEN 'just now' WHEN s < 60 THEN s || ' sec' WHEN s < 3600 THEN (s // 60) || ' min' WHEN s < 86400 THEN (s // 3600) || ' hr' WHEN s < 2592000 THEN (s // 86400) || ' day' WHEN s < 31536000 THEN (s // 2592000) || ' mo' ELSE (s // 31536000) || ' yr' END AS ago0 FROM x""".replace("AS ago0 FROM x", "AS ago FROM x"))
def small_scalars(spark, d):
    k, size = (F.col("p_size") % 6 + 1).cast("int"), F.col("p_size").cast("long")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), k)
    ago = text.relative_time(size * size * 7919)
    return t(spark, d, "part").select(
        "p_partkey", text.work_arrangement(pick(["Remote", "on-site", "ON SITE", "Hybrid", "hy_brid", "moon"])).alias("arrangement"), text.initial(pick(["Örtel", "3M", " acme", "Élan", "", "ßx"])).alias("initial"),
        urls.ats_listing_id(F.lit("Lever"), F.lit("ACME"), F.col("p_partkey").cast("string")).alias("listing_id"), F.regexp_replace(ago, "s? ago$", "").alias("ago"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '') AS pretty, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, 'a b' AS none FROM pages")
def url_labels(spark, d):
    u = F.col("url")
    return t(spark, d, "pages").select("page_id", text.pretty_url(u).alias("pretty"), text.host_of(u).alias("host"), text.host_of(F.lit("a b/c")).alias("none"))


@query("""WITH s AS (SELECT o_custkey AS k, list(CAST(o_totalprice AS DOUBLE) ORDER BY o_orderdate, o_orderkey) AS xs FROM orders GROUP BY 1),
m AS (SELECT *, list_min(xs) AS lo, list_max(xs) AS hi, len(xs) AS n FROM s),
y AS (SELECT *, list_transform(xs, lambda v: CASE WHEN hi = lo THEN 16.0 ELSE 26.0 - (v - lo) / (hi - lo) * 20.0 END) AS ys FROM m)
SELECT k, CASE WHEN n = 1 THEN '0,16.0 100,16.0' ELSE array_to_string(list_transform(range(1, n + 1), lambda i: printf('%.1f', round((i - 1) / greatest(n - 1, 1) * 100, 1)) || ',' || printf('%.1f', round(ys[i], 1))), ' ') END AS points FROM y""")
def sparklines(spark, d):
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))).alias("s"))
    return o.select("k", text.sparkline(F.transform("s", lambda x: x["o_totalprice"]), 100, 32).alias("points"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN false WHEN o_orderstatus = 'F' THEN true ELSE TIMESTAMP '1998-01-01' >= o_orderdate + INTERVAL 30 DAY END AS due FROM orders")
def due_cycles(spark, d):
    s = F.col("o_orderstatus")
    return t(spark, d, "orders").select("o_orderkey", frontier.due(_ts("1998-01-01"), F.when(s != "F", F.col("o_orderdate")), s == "P", 30 * 86_400).alias("due"))


@query(r"""SELECT doc_id, left('[' || lang || '] ' || text, 200) AS prompt FROM documents WHERE NOT contains(text, '[') AND NOT contains(text, ']')""")
def prompt_forms(spark, d):
    r = F.concat(F.lit("["), "lang", F.lit("](https://x.org/"), F.col("doc_id").cast("string"), F.lit(") "), "text")
    docs = t(spark, d, "documents").filter(~F.contains("text", F.lit("[")) & ~F.contains("text", F.lit("]")))
    return docs.select("doc_id", rendering.prompt_form(r, 200).alias("prompt"))


# --- search ---------------------------------------------------------------------------------

#: Documents as listings with short titles: the first four words.
SHORT = r"""c AS (SELECT doc_id AS id, array_to_string(list_slice(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1, 4), ' ') AS title, text AS description, upper(lang) AS country, TIMESTAMP '2024-01-01' + to_seconds(CAST(n_chars AS INT)) AS last_seen, source = 'src1' AS closed FROM documents),
k AS (SELECT * FROM (VALUES ('anea'), ('thereed')) v(kw)),
kg AS (SELECT kw, list_distinct(list_transform(range(1, length(kw) + 2), lambda i: substring('  ' || kw || ' ', i, 3))) AS g FROM k),
tt AS (SELECT *, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') AS tw, regexp_extract_all(lower(description), '[\p{L}\p{N}]+') AS bw FROM c),
runs AS (SELECT DISTINCT id, list_slice(tw, i, j) AS ws FROM (SELECT id, tw, unnest(range(1, len(tw) + 1)) AS i FROM tt), (SELECT unnest(range(1, 13)) AS j) WHERE j >= i AND j <= len(tw)),
grams AS (SELECT id, list_distinct(flatten(list_transform(ws, lambda x: list_transform(range(1, length(x) + 2), lambda i: substring('  ' || x || ' ', i, 3))))) AS rg FROM runs),
sim AS (SELECT id, kw, max(len(list_intersect(rg, g)) / (len(rg) + len(g) - len(list_intersect(rg, g)))) AS s FROM grams, kg GROUP BY ALL),
hit AS (SELECT tt.id, kw, list_contains(tw, kw) AS in_title, list_contains(bw, kw) AS in_body, coalesce(s, 0) >= 0.3 AS fuzzy FROM tt CROSS JOIN k LEFT JOIN sim USING (id, kw)),
a AS (SELECT id, bool_and(in_title OR in_body OR fuzzy) AS fits, bool_and(in_title OR in_body) AS exact, sum(CASE WHEN in_title THEN 1 ELSE 0 END + CASE WHEN in_body THEN 0.4 ELSE 0 END) AS r FROM hit GROUP BY 1)"""


def _short(spark, d):
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    at = _ts("2024-01-01") + F.make_dt_interval(secs=F.col("n_chars"))
    return t(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.array_join(F.slice(words, 1, 4), " ").alias("title"), F.col("text").alias("description"), F.upper("lang").alias("country"), F.lit("remote").alias("work_arrangement"), at.alias("first_seen"), at.alias("last_seen"),
        F.when(F.col("source") == "src1", at).alias("closed_at"))


@query(f"WITH {SHORT} SELECT c.id, title, CAST(round(CASE WHEN exact THEN r ELSE 0 END, 4) AS DOUBLE) AS rank FROM c JOIN a USING (id) WHERE fits AND NOT closed ORDER BY rank DESC, last_seen DESC, c.id LIMIT 100")
def search_fuzzy(spark, d):
    """Each keyword exactly, or by a title that is close to it; what only a close title let in ranks last."""
    return search.search_listings(_short(spark, d), search.ListingQuery(keywords=["anea", "thereed"])).select("id", "title", "rank")


@query(f"WITH {SHORT} SELECT c.id, title, CAST(round(CASE WHEN exact THEN r ELSE 0 END, 4) AS DOUBLE) AS rank FROM c JOIN a USING (id) WHERE fits AND country = 'EN' ORDER BY rank DESC, last_seen DESC, c.id LIMIT 100")
def saved_search_results(spark, d):
    saved = {"name": "n", **search.valid_saved_search(" n ", ["en "], ["Remote"]), "keywords": ["anea", "thereed"]}
    return search.search_listings(_short(spark, d), search.of_saved_search(saved, include_closed=True)).select("id", "title", "rank")


@query("WITH c AS (SELECT doc_id AS id, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 61 AS INT)) AS first_seen FROM documents WHERE source IS DISTINCT FROM 'src1') SELECT id, first_seen FROM c ORDER BY first_seen DESC, id LIMIT 50")
def recent_feed(spark, d):
    return search.search_listings(corpus(spark, d), search.ListingQuery(sort="found", limit=search.recent_limit(400))).select("id", "first_seen")
