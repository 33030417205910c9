"""Files, streams and edge cases of operators that the queries do not reach."""

import datetime as dt
import random

import pandas as pd
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from jobloom import registry
from jobloom.functions import geo, text
from jobloom.operators import frontier, gate, ingest, review, search, state, work
from jobloom.plans import page_queries
from jobloom.sources import captures, feeds, postings, robots
from jobloom.sources.html import parse_pages, scan_jsonld
from jobloom.streaming import stages

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def pages_of(folder, *html):
    """A folder with a table of these pages."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    ids = list(range(len(html)))
    pq.write_table(pa.table({"page_id": pa.array(ids, pa.int64()), "url": [f"https://x.org/{i}" for i in ids], "html": pa.array(html, pa.string())}), folder / "pages.parquet")
    return str(folder)


# --- files ----------------------------------------------------------------------------------


def test_capture_files(spark, tmp_path):
    content = "named_struct('Title', 't', 'MainContent', 'm', 'URLs', array('u'), 'JSONLD', array(), 'SiteName', '', 'Embeds', array(named_struct('Src', 's', 'IsFrame', true)), 'ElementIDs', array())"
    rows = spark.range(6).selectExpr("concat('https://x.org/', id % 4) AS url", "id % 2 = 0 AS verdict", "concat('2024-01-0', id + 1) AS ts", "'r' AS renderer", f"{content} AS content", "id AS seq")
    path = str(tmp_path / "captures")
    captures.write_captures(rows.filter("seq < 3"), "seq", path, 10)
    captures.write_captures(rows.filter("seq >= 3"), "seq", path, 1)
    lines = captures.numbered_lines(spark, path)
    assert lines.count() == 5
    got = {r["url"]: (r["verdict"], len(r["timeline"])) for r in captures.scan_captures(lines).collect()}
    assert got == {"https://x.org/0": (True, 2), "https://x.org/1": (False, 1), "https://x.org/2": (True, 1), "https://x.org/3": (False, 1)}


def test_gold_files_and_sheets(spark, tmp_path):
    rows = spark.createDataFrame([("b", "detail", 'no"te\twith\nbreaks', 2.5), ("a", None, "", 1.0)], "url string, label string, note string, weight double")
    gold = rows.selectExpr("url", "true AS verdict", "'t' AS ts", "'r' AS renderer", "label", "'s' AS stratum", "weight", "named_struct('proposed_by', 'me', 'note', note) AS label_provenance")
    captures.write_gold(gold, str(tmp_path / "gold"))
    back = captures.read_gold(spark, str(tmp_path / "gold"))
    assert [(r["url"], r["label"], r["weight"], r["label_provenance"]["proposed_by"], r["expected"]) for r in back.collect()] == [("a", None, 1.0, "me", None), ("b", "detail", 2.5, "me", None)]
    sheet = rows.select("url", "label", "note", *[F.lit("").alias(c) for c in captures.LABEL_SHEET if c not in ("url", "label", "note")])
    captures.write_sheet(sheet, captures.LABEL_SHEET, str(tmp_path / "sheet"))
    got = captures.read_sheet(spark, captures.LABEL_SHEET, str(tmp_path / "sheet")).collect()
    assert [(r["url"], r["label"], r["note"]) for r in got] == [("a", "", ""), ("b", "detail", 'no"te with breaks')]
    with pytest.raises(ValueError):
        captures.read_sheet(spark, captures.EXPECTED_SHEET, str(tmp_path / "sheet"))


# --- small functions ------------------------------------------------------------------------


def test_robots_rules():
    rules = robots.parse_rules("User-agent: a\nUser-agent: mybot\nDisallow: /x # c\nAllow:\n\nUser-agent: *\nDisallow: /", "MyBot/2")
    assert rules == [(False, "/x")] and robots.parse_rules(None, "x") == [] and robots.parse_rules("Disallow: /", "x") == []


def test_lenient_json(spark):
    ask = lambda x: one(spark, postings.lenient_json(F.lit(x)))
    assert ask('a {"b": {"c": 1}} d') == '{"b": {"c": 1}}' and ask("[1]") is None and ask("") is None and ask(None) is None and ask("{x}") is None


def test_structured_postings():
    block = lambda x: scan_jsonld(['{"@type":"JobPosting",' + x + "}"])
    assert block('"jobLocation":{"address":"Wien &amp; Graz"}')["location"] == "Wien & Graz"
    assert block('"jobLocation":[{"x":1},{"address":[{},{"addressRegion":["",{"name":"NÖ"}]}]}]')["location"] == "NÖ"
    assert block('"jobLocationType":["x","Telecommute"]')["remote"] and not block('"jobLocationType":null')["remote"]
    assert block('"description":{"x":1}')["description"] == "" and block('"description":"team of &lt;10 <b>now</b>"')["description"] == "team of <10 now"


def test_saved_searches():
    assert search.recent_limit(None) == 12 and search.recent_limit(0) == 1 and search.recent_limit(99) == 50
    for bad in (("", [], []), ("n", ["deu"], []), ("n", [], ["moon"])):
        with pytest.raises(ValueError):
            search.valid_saved_search(*bad)
    q = search.of_saved_search({"keywords": None, "countries": ["DE"]}, True)
    assert (q.keywords, q.countries, q.include_closed, q.sort) == ([], ["DE"], True, "relevance")


def test_fuzzy_titles_by_brute_force(spark):
    rng = random.Random(1)
    words = ["front", "end", "engineer", "enginer", "the", "a", "front", "ends"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(150)] + ["the " * 40 + "front end", "front front front end", ""]
    grams = lambda ws: {("  " + w + " ")[i : i + 3] for w in ws for i in range(len(w) + 1)}

    def best(keyword, title):
        key, ws = grams(keyword), title.split()
        runs = [grams(ws[i:j]) for i in range(len(ws)) for j in range(i + 1, len(ws) + 1)]
        return max((len(key & r) / len(key | r) for r in runs), default=0.0)

    df = spark.createDataFrame([(i, x) for i, x in enumerate(titles)], "id long, title string")
    for keyword in ("front-end", "engineer", "front end engineer"):
        got = {r["id"]: r["s"] for r in df.select("id", text.strict_word_similarity(keyword, F.col("title")).alias("s")).collect()}
        for i, x in enumerate(titles):
            want = best(keyword.replace("-", " ").split(), x)
            assert (got[i] == pytest.approx(want)) if want >= 0.3 else got[i] < 0.3


def test_countries(spark):
    codes = geo.iso_codes(spark)
    ask = lambda h, by, place: one(spark, geo.hinted(F.lit(h), F.lit(by), F.lit(place), codes))
    assert ask("de", "", "FR") == "DE" and ask("xx", "", "FR") == "FR" and ask("Deutschland", "DE", "FR") == "DE" and ask(None, None, "") == ""
    long = spark.createDataFrame([("country", "a b c d e f", "AA")], "layer string, phrase string, code string")
    assert geo.resolve(spark.createDataFrame([("x A b c d e F y",)], "location string"), long).first()["country"] == "AA"


def test_scorecards_of_nothing(spark):
    none = spark.createDataFrame([], "url string, category string, positive boolean, verified boolean, outcome string, votes array<boolean>")
    assert review.vote_scorecard(none).first()["flip_rate"] == 0 and review.review_queue(none).count() == 0
    rows = spark.range(10).selectExpr("'a' AS label", "id")
    assert review.subsample(rows, "label", "id", 0).count() == 10
    for n in (1, 3, 4, 7, 10, 12):
        got = [r["id"] for r in review.subsample(rows, "label", "id", n).orderBy("id").collect()]
        assert got == (list(range(10)) if n >= 10 else [int(i * 10 / n) for i in range(n)])


def test_rungs(spark):
    f = {r["page_id"]: r for r in page_queries.facts(spark, DATA).select("page_id", "embed", "openings_index", "n_links", "url").collect()}
    got = {r["page_id"]: r["rung"] for r in page_queries.page_rungs(spark, DATA).collect()}
    for i, r in f.items():
        if got[i] in ("ats_embed", "openings_index"):
            assert r["embed"] if got[i] == "ats_embed" else r["openings_index"] and not r["embed"]
        assert got[i] in ("index_terminal", "bare_or_locale_root", "reject_path", "career_index", "ats_embed", "openings_index", "positive_evidence", "")
    assert {"ats_embed", "openings_index", "positive_evidence"} <= set(got.values())


# --- frontier, work, streams ----------------------------------------------------------------


@pytest.mark.parametrize("cap", [1, 5, 37, 99, 100, 1000])
def test_newest_by_brute_force(spark, cap, monkeypatch):
    monkeypatch.setattr(frontier, "EDGE_ROWS", 4)
    rng = random.Random(cap)
    rows = [(f"u{i}", rng.choice([1, 2, 3, 10**12 + rng.randrange(50)])) for i in range(100)]
    got = frontier.newest(spark.createDataFrame(rows, "url string, seq long"), cap).collect()
    assert sorted((r["seq"], r["url"]) for r in got) == sorted((s, u) for u, s in rows)[-cap:]


def test_work_until_it_is_dead(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    days = [F.lit(f"2024-01-0{k}").cast("timestamp") for k in (1, 2, 3)]
    w = spark.createDataFrame([], "id long, payload string, attempts int, delivered_at timestamp")
    dead = spark.createDataFrame([], "id long, payload string, attempts int, dead_at timestamp")
    w, refused = work.submit(w, spark.range(3).selectExpr("id", "'p' AS payload"), 2)
    assert w.count() == 2 and [r["id"] for r in refused.collect()] == [2]
    for k in range(3):
        w, given = work.deliver(w, days[k], 10, 0)
        w, dead = work.settle(w, given.selectExpr("id", "id = 1 AND false AS ok"), dead, now)
    assert w.count() == 0 and {r["attempts"] for r in dead.collect()} == {3}
    w, given = work.deliver(spark.createDataFrame([(1, "p", 1, dt.datetime(2024, 1, 1))], "id long, payload string, attempts int, delivered_at timestamp"), now, 10, 60)
    assert given.count() == 0


def test_all_dead_letters_are_returned(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    n = work.DEAD_LETTERS + 5
    w = spark.range(n).selectExpr("id", "'p' AS payload", "3 AS attempts", "CAST(NULL AS timestamp) AS delivered_at")
    old = spark.range(n, n + 2).selectExpr("id", "'p' AS payload", "3 AS attempts", "TIMESTAMP '2023-01-01' AS dead_at")
    left, dead = work.settle(w, w.selectExpr("id", "false AS ok"), old, now)
    assert left.count() == 0 and dead.count() == dead.select("id").distinct().count() == n + 2
    assert [r["id"] for r in work.retained(dead, 3).orderBy("id").collect()] == [n - 3, n - 2, n - 1]


def test_intake_stays_bounded(spark, tmp_path):
    rows = [(f"https://x.org/{i % 30}?utm_source={i}", i % 5, i) for i in range(90)] + [("https://x.org/0/", 0, 100)]
    df = spark.createDataFrame(rows, "url string, depth int, seq long")
    for part in range(3):
        df.filter(F.floor(F.col("seq") / 40) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        stages.start_intake(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 10, 3).awaitTermination()
    admitted = spark.read.parquet(str(tmp_path / "out/admitted"))
    assert admitted.filter("batch = 0").count() == admitted.filter("batch = 0").select("url").distinct().count() == 24
    assert all(spark.read.parquet(str(tmp_path / f"out/seen/{i}")).count() == 10 for i in range(3))


def test_streamed_probes_fold_as_tables_do(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(5), rng.choice(["alive", "dead", "inconclusive", "inconclusive"]), rng.random() < 0.5) for k in range(60) for _ in range(rng.randrange(1, 8))]
    got = {r["key"]: (r["open"], r["streak"]) for r in state.fold_liveness(spark.createDataFrame(rows, "key long, at long, outcome string, complete boolean")).collect()}
    for k in got:
        mine = pd.DataFrame([r[1:] for r in rows if r[0] == k], columns=["at", "outcome", "complete"])
        assert stages.folded((True, 0), mine, 3) == got[k]


# --- boards ---------------------------------------------------------------------------------


def test_board_completeness(spark):
    pages = spark.createDataFrame([("a", '{"total":2,"items":[{"id":"1"}]}'), ("a", '{"total":2,"items":[{"id":"2"}]}'), ("b", '{"total":3,"items":[{"id":"1"}]}'), ("c", "broken"), ("d", '{"total":0,"items":[]}'), ("e", '{"total":1,"items":[{"id":""}]}')], "tenant string, payload string")
    got = {r["tenant"]: (r["n_listings"], r["complete"]) for r in feeds.boards("manatal", pages, feeds.manatal(pages), spark.createDataFrame([("d",)], "tenant string")).collect()}
    assert got == {"a": (2, True), "b": (1, False), "c": (0, False), "d": (0, False), "e": (0, False)}


def test_payloads_that_are_no_payloads(spark):
    for name, f in feeds.FEEDS.items():
        for payload in ("", "nonsense", "{}", "[]", None):
            assert f(spark.createDataFrame([("t", payload)], "tenant string, payload string")).count() == 0, (name, payload)


def test_incomplete_and_failed_boards_close_nothing(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    schema = "canonical_url string, url string, source string, career_page_id long, title string, discovered_depth int, first_seen timestamp, last_seen timestamp, closed_at timestamp, inconclusive_streak int"
    old = spark.createDataFrame([(f"{t}-{i}", "u", "ats", p, "t", None, day(1), day(1), None, 0) for p, t in enumerate("abc") for i in range(2)], schema)
    tasks = spark.createDataFrame([("x", t, p) for p, t in enumerate("abc")], "provider string, tenant string, career_page_id long")
    boards = spark.createDataFrame([("x", "a", 200, True), ("x", "b", 200, False), ("x", "c", 404, True)], "provider string, tenant string, status int, complete boolean")
    found = spark.createDataFrame([("a-0", "u", "ats", 0, "new"), ("b-9", "u", "ats", 1, "new")], "canonical_url string, url string, source string, career_page_id long, title string")
    now = F.lit("2024-02-01").cast("timestamp")
    after, probes = ingest.ingest_boards(old, tasks, found, boards, now, now)
    closed = {r["canonical_url"]: r["closed_at"] is not None for r in after.collect()}
    assert closed == {"a-0": False, "a-1": True, "b-0": False, "b-1": False, "b-9": False, "c-0": False, "c-1": False}
    assert {r["page_id"]: r["outcome"] for r in probes.collect()} == {0: "alive", 1: "alive", 2: "dead"}


def test_filters(spark):
    ask = lambda c: one(spark, c)
    assert ask(gate.every()) and not ask(gate.every(F.lit(True), F.lit(None).cast("boolean"))) and not ask(gate.chain(("block", gate.reject())))
    good = gate.content_filter(F.lit("Dev job"), F.lit("apply"), [lambda c: text.contains_word(c, "job")], [lambda c: text.contains_text(c, "APP")])
    assert ask(good) and not ask(text.contains_text(F.lit("x"), "")) and not ask(text.contains_word(F.lit("x"), ""))
    assert ask(postings.in_scope(F.lit("https://jobs.acme.com/x"), F.lit("acme.com"))) and not ask(postings.in_scope(F.lit("https://b.org"), F.lit("acme.com"))) and ask(postings.in_scope(F.lit("x"), F.lit("")))


def test_free_extraction_of_pages_that_show_little(spark, tmp_path):
    pages = ["<article><h1>De.</h1><p><b>De.<br></article>", "", "<script>", "<!-- left", "<p>Weg</p><p>x</p>", None]
    pages = [p if p is None else p + " " * (-len(p) % 8) for p in pages] + ["<p>x"]
    folder = pages_of(tmp_path, *pages)
    df = page_queries.free_extraction(spark, folder)
    assert df.count() == 5 and same_rows(df, registry.ORACLES["free_extraction"], folder)


@pytest.mark.parametrize(("text", "free"), [("Do it", False), ("Do this, and more of it", True), ("This job was removed. Do this, and more of it", False)])
def test_what_a_page_withdraws_is_no_free_extraction(spark, text, free):
    page = f'<script type="application/ld+json">{page_queries.LD}</script><article>{text}</article>'
    rows = spark.createDataFrame([(1, "https://x.org/1", page)], "page_id long, url string, html string")
    listings, others = postings.free_extractions(postings.page_facts(parse_pages(rows)))
    assert (listings.count(), others.count()) == ((1, 0) if free else (0, 1))


def test_page_content_of_titles_with_references(spark, tmp_path):
    titles = ["a&amp;&amp;b&amp", "The&a", "x = &quot;1&quot", "&lt;b&gt; &#65;&nbsp;&amp;quot;", " a \n\t b ", "a\u00a0 b", "&copy;&copy&amp;amp;", "&", ""]
    pages = [f'<title>{x}</title><a href="/?a&amp;b&copy">1</a><a class="c" href="/2">2</a><a>3</a><h1>h &amp; h</h1>' for x in titles]
    folder = pages_of(tmp_path, *pages, "<h1>only</h1>", "", None)
    df = registry.QUERIES["page_content"](spark, folder)
    assert same_rows(df, registry.ORACLES["page_content"], folder)
    rows = spark.createDataFrame([(1, "u", "<title> a &quot;b&quot; &amp</title>")], "page_id long, url string, html string")
    assert [tuple(r) for r in parse_pages(rows).select("title", "title_text").collect()] == [('a "b" &', ' a "b" &')]
