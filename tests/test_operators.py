import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobloom.functions import geo, text, urls
from jobloom.operators import evaluate, gate, search, state
from jobloom.sources import feeds, html
from jobloom.streaming import stages


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("url", "want"), [
    ("HTTPS://WWW.Example.com/Jobs/?utm_source=x&b=2&a=1#top", "https://www.example.com/Jobs?a=1&b=2"),
    ("http://a.de/", "http://a.de/"), ("http://a.de/x//", "http://a.de/x"), ("not a url", "not a url"), ("http://a.de/a b?gclid=1", "http://a.de/a b"),
])
def test_frontier_url(spark, url, want):
    assert one(spark, urls.frontier_url(F.lit(url))) == want


def test_listing_and_page_url(spark):
    u = F.lit("http://www.a.de/jobs/1/?utm_foo=1&_ga=2&x=3#f")
    assert one(spark, urls.listing_url(u)) == "https://a.de/jobs/1?utm_foo=1&x=3"
    assert one(spark, urls.page_url(u)) == "https://www.a.de/jobs/1"
    assert one(spark, urls.ats_listing_id(F.lit("Lever"), F.lit("ACME"), F.lit("Ab1"))) == "lever:acme:Ab1"


def test_path_prefix(spark):
    fits = lambda u, p: one(spark, urls.has_path_prefix(F.lit(u), F.lit(p)))
    assert fits("https://a/jobs/1", "https://a/jobs") and fits("https://a/jobs", "https://a/jobs") and not fits("https://a/jobsx", "https://a/jobs")


def test_similarity_points(spark):
    assert round(one(spark, text.strict_word_similarity("enginer", F.lit("Senior Engineer"))), 2) == 0.7
    assert round(one(spark, text.strict_word_similarity("nestjs", F.lit("neuesten"))), 4) == 0.2308


def test_text_scalars(spark):
    assert one(spark, text.fold(F.lit("MÜNCHEN Straße"))) == "munchen strasse"
    assert one(spark, text.work_arrangement(F.lit("On-Site"))) == "onsite" and one(spark, text.work_arrangement(F.lit("?"))) == "unspecified"
    assert one(spark, text.initial(F.lit("Örtel"))) == "O" and one(spark, text.initial(F.lit("3M"))) == "0-9"
    assert [one(spark, text.relative_time(F.lit(s))) for s in (4, 59, 7300)] == ["just now", "59 secs ago", "2 hrs ago"]
    assert one(spark, text.contains_word(F.lit("für Job"), "job")) and not one(spark, text.contains_word(F.lit("jobs"), "job"))


def test_gazetteer(spark):
    places = {"Bern": "CH", "Salzburg": "AT", "Remote, unspecified": "", "European Union": "", "Stockholm, London": "GB", "Remote, Canada; Remote, US": "CA", "Canada": "CA", "Atlanta, Georgia, USA": "US", "North Korea": "KP", "München": "DE", "": ""}
    df = spark.createDataFrame([(p,) for p in places], "location string")
    gaz = spark.createDataFrame(geo.GAZETTEER, "layer string, phrase string, code string")
    assert {r["location"]: r["country"] for r in geo.resolve(df, gaz).collect()} == places


PROBES = [("alive", True, (True, 0)), ("dead", True, (False, 0)), ("dead", False, (True, 0)), ("inconclusive", True, (True, 1))]


@pytest.mark.parametrize(("outcome", "complete", "want"), PROBES)
def test_liveness_steps(spark, outcome, complete, want):
    df = spark.createDataFrame([(1, 1, outcome, complete)], "key long, at long, outcome string, complete boolean")
    r = state.fold_liveness(df).first()
    assert (r["open"], r["streak"]) == want


@pytest.mark.parametrize(("threshold", "is_open"), [(3, False), (0, True), (-1, True), (4, True)])
def test_liveness_threshold(spark, threshold, is_open):
    df = spark.createDataFrame([(1, i, "inconclusive", True) for i in range(3)], "key long, at long, outcome string, complete boolean")
    assert state.fold_liveness(df, threshold).first()["open"] is is_open


def test_liveness_stream_agrees_with_batch(spark, tmp_path):
    rows = [(k, i, ["alive", "dead", "inconclusive", "inconclusive"][(k * 7 + i * i) % 4], i % 3 > 0) for k in range(8) for i in range(9)]
    df = spark.createDataFrame(rows, "key long, at long, outcome string, complete boolean")
    for part in range(3):
        df.filter(F.floor(F.col("at") / 3) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stages.liveness_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("append").parquet(str(tmp_path / f"out{i}"))).start()
        q.awaitTermination()
    got = {}
    for i in range(3):
        got |= {r["key"]: (r["open"], r["streak"]) for r in spark.read.parquet(str(tmp_path / f"out{i}")).collect()}
    assert got == {r["key"]: (r["open"], r["streak"]) for r in state.fold_liveness(df).collect()}


def test_merge_twice_is_merge_once(spark):
    schema = "company_key string, name string, website string, name_source string, first_seen timestamp, last_seen timestamp"
    day = lambda n: dt.datetime(2024, 1, n)
    old = spark.createDataFrame([("a", "A", None, "meta", day(5), day(9)), ("b", "B", "w", "llm", day(5), day(9))], schema)
    file = spark.createDataFrame([("a", "AA", "x", day(1), day(3)), ("c", "C", None, day(9), day(2))], "company_key string, name string, website string, first_seen timestamp, last_seen timestamp")
    once = state.merge_companies(old, file)
    assert sorted(once.collect(), key=str) == sorted(state.merge_companies(once, file).collect(), key=str)
    rows = {r["company_key"]: r for r in once.collect()}
    assert rows["a"]["name_source"] is None and rows["a"]["first_seen"] == day(1) and rows["c"]["first_seen"] == day(2)


def test_search_orders(spark):
    ts = dt.datetime(2024, 1, 1)
    rows = [(1, "Go developer", "x", "DE", "remote", ts, ts, None), (2, "Cook", "go developer wanted", "DE", "remote", ts, ts, None), (3, "Go developr", "", "US", "onsite", ts, ts, None), (4, "Go developer", "", "DE", "remote", ts, ts, ts)]
    df = spark.createDataFrame(rows, "id long, title string, description string, country string, work_arrangement string, first_seen timestamp, last_seen timestamp, closed_at timestamp")
    ids = lambda **k: [r["id"] for r in search.search_listings(df, search.ListingQuery(**k)).collect()]
    assert ids(keywords=["developer"]) == [1, 2, 3]  # title, then body, then only close
    assert ids(keywords=['"go developer" -wanted'], fuzzy=False) == [1]
    assert ids(keywords=["cook or developer"], fuzzy=False, include_closed=True) == [2, 1, 4]  # title and body
    assert ids(keywords=[" "], countries=["us"]) == [3] and ids(limit=1, offset=1) == [2]


def test_gate(spark):
    g = lambda u, title="", n=0: tuple(one(spark, gate.gate(F.lit(u), F.lit(title), F.lit(n), F.lit(False), F.lit(False))))
    assert g("https://a.de/careers") == (True, True) and g("https://a.de/blog/careers") == (False, False) and g("https://a.de/jobs/go-dev") == (False, False)
    assert g("https://a.de/join", "Careers at A") == (True, False) and g("https://a.de/join", "x", 4) == (True, True) and g("https://a.de/x") == (False, False)
    assert one(spark, gate.posting_url(F.lit("https://karriere.a.de/dev"))) and not one(spark, gate.posting_url(F.lit("https://a.de/jobs")))
    assert one(spark, gate.role_designation(F.lit("Dev (m/w/d)"))) and one(spark, gate.saturation(F.lit(9), 5)) == 1.0 and one(spark, gate.saturation(F.lit(9), 0)) == 0.0


def test_html():
    page = html.parse_page('<title>T &amp; x</title><nav>menu</nav><main>Hello <script>no</script><b>you</b></main><a href="/j">k</a><iframe src="u"></iframe><script type="application/ld+json">{"@type":"JobPosting","title":"Dev"}</script>')
    assert page["title"] == "T & x" and page["main_content"] == "Hello you" and page["urls"] == ["/j"] and page["embeds"] == [{"src": "u", "is_frame": True}]
    scan = html.scan_jsonld(page["jsonld"])
    assert html.stratum(scan) == "lone" and scan["title"] == "Dev" and html.parse_page(None)["title"] == ""
    assert html.stratum(html.scan_jsonld(['{"@type":"ItemList","x":[{"@type":"JobPosting","title":"a"}]}', "broken"])) == "ambiguous"


def test_feeds(spark):
    load = lambda name, payload: feeds.FEEDS[name](spark.createDataFrame([("acme", payload)], "tenant string, payload string")).collect()
    g = load("greenhouse", '{"jobs":[{"id":1,"absolute_url":"u","title":"t","location":{"name":"Berlin"},"departments":[{"name":"d"}]},{"id":2,"title":"no url"}]}')
    assert [(r["source_id"], r["location"], r["department"]) for r in g] == [("1", "Berlin", "d")]
    assert load("lever", '[{"id":"x","hostedUrl":"u","text":"t","createdAt":1700000000000,"description":"a","lists":[{"text":"b","content":"c"}],"additional":"d"}]')[0]["body"] == "a\nb\nc\nd"
    p = load("personio", "<r><position><id>7</id><name>n</name><office>Bonn</office><additionalOffices><office>Ulm</office></additionalOffices></position></r>")
    assert (p[0]["url"], p[0]["location"]) == ("https://acme.jobs.personio.de/job/7", "Bonn, Ulm")
    tt = load("teamtailor", "<rss><channel><item><title>t</title><link>https://x/jobs/123-dev</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>")
    assert tt[0]["source_id"] == "123" and tt[0]["published"] == dt.datetime(2024, 1, 1, 10)


def test_growth_fills_gaps(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 4),)], "ts timestamp")
    rows = evaluate.growth(df, "ts", F.lit("2024-01-05").cast("timestamp"), 0).orderBy("day").collect()
    assert [r["total"] for r in rows] == [1, 1, 1, 2, 2]
    assert evaluate.growth(df.limit(0), "ts", F.lit("2024-01-05").cast("timestamp"), 5).count() == 0
