import pytest
from pyspark.sql import functions as F

from jobloom.functions import names, rendering
from jobloom.operators import edits
from jobloom.sources.html import organization

TITLES = {
    "Jobs at Acme": "Acme", "Careers - PostHog": "PostHog", "PostHog | Careers": "PostHog", "Acme Careers": "Acme", "Join Acme": "Acme", "Acme": None, "Careers": None,
    "Offene Stellen": None, "Die neuesten Angebote": None, "Jobs bei der\n Commerzbank": "Commerzbank", "Acme Jobs Careers": "Acme", "Open Positions | Careers": "Open Positions |", "": None, None: None,
    "Work at us at The Guardian": "The Guardian", "Acme Careers Jobs": "Acme Careers", "Careers — Team · Acme": "Team · Acme", "Acme :: jobs": "Acme", "Team 100 | Careers": "Team 100", "Careers - 0x0": "0x0",
}


def test_title_names(spark):
    rows = spark.createDataFrame([(t,) for t in TITLES], "t string").select("t", names.title_name(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == TITLES


def test_name_ladder(spark):
    rows = [
        (1, " Org ", "Site", "", "Model", "Join X", "k.com", "Org", "jsonld"), (2, "", "Acme | Careers", "", "Model", "", "k.com", "Acme", "meta"), (3, None, "Remote", None, None, None, "k.com", "Remote", "meta"),
        (4, "", "Board", "lever", " Model ", "", "lever:acme", "Model", "llm"), (5, "", "Board", "lever", "", "Jobs at X", "lever:acme", "X", "title"), (6, "", "Careers", "", "", "Bare", "acme.com", "acme.com", "domain"),
        (7, None, None, "lever", None, None, "lever:acme", "acme", "domain"),
    ]
    df = spark.createDataFrame(rows, "i int, o string, s string, p string, m string, t string, k string, name string, source string")
    got = df.select("name", "source", names.company_name(*[F.col(c) for c in "ospmtk"]).alias("got")).collect()
    assert [(r.got.name, r.got.source) for r in got] == [(r["name"], r.source) for r in got]


def test_organization():
    assert organization(['{"@type":"Organization","name":"Host"}', '[{"@type":"JobPosting","hiringOrganization":{"@type":"Organization","name":" Acme ","sameAs":["x","https://www.acme.com/a"]}}]', "{bad"]) == {"name": "Acme", "host": "www.acme.com"}
    assert organization(['{"@graph":[{"@type":["Thing","LocalOrganization"],"name":"G","url":"https://g.org"}]}']) == {"name": "G", "host": "g.org"}
    assert organization(['{"name":"no type"}', "3", "[]"]) == {"name": "", "host": ""} == organization(None)


R = "#\vTitle\t\nnext [a [b] c](/x) end\n-\v[button: Go] [img: logo] word\n|\vone\ttwo\n[input checkbox: role] - \v\n[inputs are welcome] ] [](y)"


def test_readings_of_renderings(spark):
    df = spark.createDataFrame([(R,), ("plain  text",), ("",), (None,), ("[" * 3000 + "x](y)",)], "r string").coalesce(1)
    got = df.select(rendering.flattened_text(F.col("r")).alias("f"), rendering.without_link_targets(F.col("r")).alias("w")).collect()
    assert [r.f for r in got[:4]] == ["Titlenext a [b] c end Go word one two - [inputs are welcome] ]", "plain text", "", None]
    assert got[0].w == R.replace("(/x)", "").replace("(y)", "") and got[1].w == "plain  text"
    assert got[4].f == "[" * 2999 + "x"
    lines = rendering.scan_renderings(df.withColumn("k", F.lit(1)), "k", "r").collect()
    first = lines[0].lines
    assert [(x.block, x.level, x.joined, len(x.cells)) for x in first[:4]] == [("heading", 1, True, 1), ("paragraph", 0, False, 1), ("item", 0, False, 1), ("row", 0, False, 2)]
    assert [(p.mark, p.text, p.target) for p in first[1].cells[0]] == [("text", "next ", ""), ("link", "a [b] c", "/x"), ("text", " end", "")]
    assert [(p.mark, p.text, p.label) for p in first[2].cells[0]] == [("button", "Go", ""), ("text", " ", ""), ("control", "", "img: logo"), ("text", " word", "")]
    assert lines[2].lines == [] and lines[3].lines == []


def test_searches_and_definitions(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    assert sorted(edits.create_rows(rows, spark.createDataFrame([(2, "x"), (3, "d"), (3, "c")], rows.schema)).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert edits.delete_rows(rows, spark.createDataFrame([(2,), (9,)], "id int")).collect() == [(1, "a")]
    shape = "id int, kind string, seed_urls array<string>, created_at int"
    have, new = spark.createDataFrame([(1, "scrape", ["s"], 1)], shape), spark.createDataFrame([(2, "discovery", None, 5), (3, "discovery", ["d"], 4), (4, "scrape", None, 6)], shape)
    once = edits.create_definitions(have, new)
    assert sorted((r.id, r.seed_urls) for r in once.collect()) == [(1, ["s"]), (3, ["d"]), (4, [])]
    assert edits.create_definitions(once, new.filter("id = 2")).count() == 3


@pytest.mark.parametrize("null", [None, ""])
def test_labels(spark, null):
    shape = "url string, label string, proposed_label string, proposed_by string, proposed_at string, confirmed_by string, confirmed_at string, note string"
    rows = spark.createDataFrame([("a", "x", null, "m", "1", null, null, null), ("b", "x", null, "m", "1", "h", "2", "n"), ("c", null, null, null, null, null, null, null), ("d", "x", null, null, null, null, null, null)], shape)
    sheet = spark.createDataFrame([("a", "y", "", "", "h"), ("b", "y", "", "", ""), ("zz", "y", "", "", "")], "url string, label string, note string, proposed_by string, confirmed_by string")
    model = spark.createDataFrame([("c", "z", "why")], "url string, label string, note string")
    out = edits.apply_labels(rows, sheet, model, spark.createDataFrame([("c",)], "url string"), "bot", "eve", "9")
    assert sorted(tuple(r) for r in out.collect()) == [
        ("a", "y", "x", "m", "1", "h", "9", ""), ("b", "y", "", "m", "1", "", "", "n"), ("c", "z", "z", "bot", "9", "eve", "9", "why"), ("d", "x", "x", "bot", "9", "", "", "")]
