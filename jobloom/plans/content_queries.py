"""Queries on names, renderings, labels and saved searches, with DuckDB SQL.

The tables have no such columns, so each query lays them out from the columns there are, for every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import names, rendering
from jobloom.operators import edits
from jobloom.plans.registered import query, t
from jobloom.sources import html, page_rendering


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS n, c_nationkey % 8 AS shape FROM customer)
SELECT k AS page_id, CASE WHEN shape = 2 THEN 'acme' || k ELSE n END AS name, CASE shape WHEN 2 THEN 'domain' WHEN 5 THEN 'jsonld' WHEN 6 THEN 'meta' WHEN 7 THEN 'llm' ELSE 'title' END AS source FROM c""")
def company_names(spark, d):
    n, shape, none = F.col("c_name"), F.col("c_nationkey") % 8, F.lit(None).cast("string")
    titles = ["Jobs at @", "@ | Careers", "@", "Join @", "Careers - @ Jobs", "@", "@", "@"]
    title = F.replace(F.element_at(F.array(*map(F.lit, titles)), (shape + 1).cast("int")), F.lit("@"), n)
    pages = t(spark, d, "customer").select(
        F.col("c_custkey").alias("page_id"), F.when(shape == 5, n).alias("organization"), F.when(shape == 6, F.concat(n, F.lit(" Careers"))).when(shape == 7, n).alias("site"),
        F.when(shape == 6, "").otherwise("lever").alias("provider"), F.when(shape == 7, F.concat(F.lit(" "), n)).otherwise(none).alias("model"), title.alias("title"),
        F.concat(F.lit("lever:acme"), F.col("c_custkey").cast("string")).alias("company_key"))
    found = names.company_name(*[F.col(c) for c in ("organization", "site", "provider", "model", "title", "company_key")])
    return pages.select("page_id", F.inline(F.array(found)))


#: A rendering of each document: a heading that runs on, a link, a control, a button, and the text as a list item.
RENDERED = r"""r AS (SELECT doc_id, '##' || chr(11) || source || chr(9) || chr(10) || lang || ' [' || source || '](/x) [img: z] [button: go]' || chr(10) || '-' || chr(11) || text AS r FROM documents)"""
_T = r"(?:[^\[\]]|\[[^\[\]]*\])*"
_C = r"\[(?:img|input|select|textarea)(?:[: ][^\]]*)?\]"


def _rendered(spark, d):
    r = F.concat(F.lit("##\v"), "source", F.lit("\t\n"), "lang", F.lit(" ["), "source", F.lit("](/x) [img: z] [button: go]\n-\v"), "text")
    return t(spark, d, "documents").select("doc_id", r.alias("r"))


@query(rf"""WITH {RENDERED}, a AS (SELECT doc_id, r, regexp_replace(replace(regexp_replace(r, '(?m)^(#{{1,6}}|-|\|)\x0B', '', 'g'), chr(9) || chr(10), ''), '{_C}', '', 'g') AS f FROM r),
b AS (SELECT doc_id, r, regexp_replace(regexp_replace(f, '\[button: ({_T})\]', '\1', 'g'), '\[({_T})\]\(([^)]*)\)', '\1', 'g') AS f FROM a)
SELECT doc_id, sha256(trim(regexp_replace(f, '[\s\p{{Z}}\x0B\x{{85}}]+', ' ', 'g'))) AS flattened, sha256(regexp_replace(r, '({_C}|\[button: {_T}\])|(\[{_T}\])\([^)]*\)', '\1\2', 'g')) AS without_targets FROM b""")
def rendering_readings(spark, d):
    r = F.col("r")
    return _rendered(spark, d).select("doc_id", F.sha2(rendering.flattened_text(r), 256).alias("flattened"), F.sha2(rendering.without_link_targets(r), 256).alias("without_targets"))


@query(rf"""WITH {RENDERED} SELECT doc_id, CAST(len(string_split(r, chr(10))) AS BIGINT) AS lines, 1 AS headings, 1 AS items, 1 AS joined FROM r WHERE r IS NOT NULL""")
def rendering_lines(spark, d):
    lines = rendering.scan_renderings(_rendered(spark, d).filter("r IS NOT NULL"), "doc_id", "r")
    n = lambda f: F.size(F.filter("lines", f))
    return lines.select("doc_id", F.size("lines").cast("long").alias("lines"), n(lambda x: x["block"] == "heading").alias("headings"), n(lambda x: x["block"] == "item").alias("items"), n(lambda x: x["joined"]).alias("joined"))


@query("""WITH x AS (SELECT l_returnflag = 'R' AS detail, l_quantity > 10 AS f, l_quantity > 12 AS s, CAST(l_quantity AS BIGINT) AS w, l_linenumber AS l, l_suppkey AS k FROM lineitem)
SELECT count(*) AS pages, CAST(sum(w + l) AS BIGINT) AS words, count(*) FILTER (WHERE f <> s) AS flips, count(*) FILTER (WHERE f <> s AND detail) AS drifted_drops, count(*) FILTER (WHERE w > 40 AND w <= 45) AS newly_truncated,
  round(CAST(count(*) FILTER (WHERE f) AS DOUBLE) / count(*), 4) AS flat_call_rate, round(CAST(sum(w) AS DOUBLE) / sum(w + l), 4) AS flat_words_share, CAST(sum(k) AS BIGINT) AS flat_runes, count(*) FILTER (WHERE w > 45) AS flat_truncated, count(*) FILTER (WHERE detail AND NOT f) AS flat_false_drops,
  round(CAST(count(*) FILTER (WHERE s) AS DOUBLE) / count(*), 4) AS structural_call_rate, round(CAST(sum(w) AS DOUBLE) / sum(w + l), 4) AS structural_words_share, CAST(sum(k + 1) AS BIGINT) AS structural_runes, count(*) FILTER (WHERE w > 40) AS structural_truncated, count(*) FILTER (WHERE detail AND NOT s) AS structural_false_drops FROM x""")
def rendering_arms(spark, d):
    w = F.col("l_quantity").cast("long")
    arm = lambda least, more, most: F.struct((F.col("l_quantity") > least).alias("extract"), w.alias("words"), (F.col("l_suppkey") + more).cast("long").alias("runes"), (w > most).alias("truncated"))
    rows = t(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("url"), F.when(F.col("l_returnflag") == "R", "detail").otherwise("hub").alias("label"), (w + F.col("l_linenumber")).alias("page_words"),
        arm(10, 0, 45).alias("flat"), arm(12, 1, 40).alias("structural"))
    return rendering.compare_arms(rows)


@query("""SELECT n_nationkey AS id, CASE WHEN n_regionkey < 3 THEN n_name ELSE 'new ' || n_name END AS name FROM nation WHERE n_regionkey <> 4""")
def saved_search_edits(spark, d):
    n = t(spark, d, "nation")
    rows = lambda cond, name: n.filter(cond).select(F.col("n_nationkey").alias("id"), name.alias("name"))
    more = edits.create_rows(rows("n_regionkey < 3", F.col("n_name")), rows("n_regionkey > 1", F.concat(F.lit("new "), F.col("n_name"))))
    return edits.delete_rows(more, rows("n_regionkey = 4", F.col("n_name")))


@query("""WITH c AS (SELECT c_custkey AS url, c_mktsegment AS label, c_acctbal < 5000 AS proposed, c_nationkey < 5 AS confirmed, c_acctbal > 0 AS sheet, c_mktsegment = 'BUILDING' AS changes FROM customer),
x AS (SELECT *, sheet AND changes AS new_label, confirmed AND NOT (sheet AND changes) AS stays FROM c)
SELECT url, CASE WHEN new_label THEN 'OTHER' ELSE label END AS label, CASE WHEN confirmed THEN '' WHEN proposed THEN label WHEN sheet THEN '' WHEN new_label THEN 'OTHER' ELSE label END AS proposed_label,
  CASE WHEN proposed THEN 'm' ELSE 'bot' END AS proposed_by, CASE WHEN proposed THEN '1' ELSE '9' END AS proposed_at,
  CASE WHEN stays THEN 'h' WHEN sheet THEN 'eve' ELSE '' END AS confirmed_by, CASE WHEN stays THEN '2' WHEN sheet THEN '9' ELSE '' END AS confirmed_at, '' AS note FROM x""")
def label_edits(spark, d):
    c = t(spark, d, "customer")
    url, none = F.col("c_custkey").alias("url"), F.lit(None).cast("string")
    proposed, confirmed = F.col("c_acctbal") < 5000, F.col("c_nationkey") < 5
    rows = c.select(
        url, F.col("c_mktsegment").alias("label"), none.alias("proposed_label"), F.when(proposed, "m").alias("proposed_by"), F.when(proposed, "1").alias("proposed_at"),
        F.when(confirmed, "h").alias("confirmed_by"), F.when(confirmed, "2").alias("confirmed_at"), none.alias("note"))
    new = F.when(F.col("c_mktsegment") == "BUILDING", "OTHER").otherwise(F.col("c_mktsegment"))
    sheet = c.filter("c_acctbal > 0").select(url, new.alias("label"), none.alias("note"), none.alias("proposed_by"), F.lit("eve").alias("confirmed_by"))
    return edits.apply_labels(rows, sheet, sheet.filter("false"), sheet.filter("false").select("url"), "bot", "", "9")


@query()
def page_renderings(spark, d):
    r = page_rendering.render_pages(t(spark, d, "pages"))
    flat = rendering.flattened_text(F.col("rendering"))
    return r.select("page_id", F.sha2("rendering", 256).alias("rendering_hash"), F.sha2(flat, 256).alias("flattened_hash"), rendering.words(flat).alias("words"))


#: Structured data of a page made from a customer's columns: one posting, a list of postings, two, or none; who hires.
_BLOCKS = {
    "AUTOMOBILE": '{"@type":"JobPosting","title":"t","hiringOrganization":{"@type":"Organization","name":"~","url":"https://www.~.org/x"}}',
    "BUILDING": '{"@type":"ItemList","itemListElement":[{"item":{"@type":"JobPosting","title":"t"}}]}',
    "FURNITURE": '[{"@type":"JobPosting"},{"@type":"jobposting"}]',
    "HOUSEHOLD": '{"@graph":[{"@type":"LocalOrganization","name":" ~ ","sameAs":["","https://~.com"]}]}',
}


@query("""SELECT c_custkey AS page_id, c_mktsegment IN ('BUILDING', 'FURNITURE') AS openings_index, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD') THEN 'k' || c_custkey ELSE '' END AS organization,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'www.k' || c_custkey || '.org' WHEN 'HOUSEHOLD' THEN 'k' || c_custkey || '.com' ELSE '' END AS organization_host FROM customer""")
def structured_data(spark, d):
    blocks = F.create_map(*[F.lit(x) for pair in _BLOCKS.items() for x in pair])
    block = F.replace(F.try_element_at(blocks, F.col("c_mktsegment")), F.lit("~"), F.concat(F.lit("k"), F.col("c_custkey").cast("string")))
    pages = t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("page_id"), F.array_compact(F.array(block, F.lit("{bad"))).alias("jsonld"))
    return html.openings_indexes(pages).join(html.organizations(pages), "page_id")
