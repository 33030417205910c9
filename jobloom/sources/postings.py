"""Parsed pages to what a gate and a corpus want to know: absolute links, the posting in structured data, the body of a
posting, postings that can be read without a model."""

from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import constants as K
from jobloom.functions import identity, urls
from jobloom.functions.rendering import flattened_text
from jobloom.operators import gate
from jobloom.sources.html import has_openings_index, scan_jsonld, stratum

POSTING = "struct<postings:int,stratum:string,openings_index:boolean,title:string,location:string,country:string,description:string,remote:boolean>"


def _joined(base: str | None, href: str) -> str | None:
    try:
        return urljoin(base or "", href)
    except ValueError:
        return None


def page_facts(parsed: DataFrame) -> DataFrame:
    """Parsed pages (page_id, url, urls, jsonld, ..) with ``links``, their links made absolute (those that cannot be are
    left out), and ``posting``, what their structured data says. Both need recursion, so they are read in one Arrow batch."""

    def found(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        names = [f.split(":")[0] for f in POSTING[7:-1].split(",")]
        for batch in batches:
            links = [[x for h in hrefs or [] if (x := _joined(base, h)) is not None] for base, hrefs in zip(batch.column("url").to_pylist(), batch.column("urls").to_pylist(), strict=True)]
            scans = [scan_jsonld(b) for b in batch.column("jsonld").to_pylist()]
            facts = [{**s, "stratum": stratum(s), "openings_index": has_openings_index(s)} for s in scans]
            posting = pa.StructArray.from_arrays([pa.array([f[n] for f in facts], k) for n, k in zip(names, kinds, strict=True)], names=names)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(links, pa.list_(pa.string())), posting], names=[*batch.schema.names, "links", "posting"])

    schema = ", ".join(f"`{n}` {k}" for n, k in parsed.dtypes) + f", links array<string>, posting {POSTING}"
    return parsed.mapInArrow(found, schema)


def outlinks(facts: DataFrame) -> DataFrame:
    """(page_id, url, depth, scope, owner) of what the frontier gets of pages (page_id, links, depth, scope, owner): each
    http link once a page, in its frontier form, one step deeper, with the scope and owner of its page. Where there is a
    scope, only links of that company go on."""
    rows = facts.select("page_id", F.explode(F.array_distinct(F.transform(F.filter("links", lambda x: x.rlike("^https?://[^/?#]")), urls.frontier_url))).alias("url"), (F.col("depth") + 1).alias("depth"), "scope", "owner")
    return rows.filter(in_scope(F.col("url"), F.col("scope")))


def in_scope(url: Column, scope: Column) -> Column:
    """Whether a URL belongs to the company that a walk is fenced to; without a fence every URL does."""
    free = F.coalesce(scope, F.lit("")) == ""
    return free | F.coalesce(identity.identify(url)["company_key"] == scope, F.lit(False))


def posting_links(facts: DataFrame) -> Column:
    """How many different links of a page lead to postings on its own host."""
    mine = F.filter("links", lambda x: (identity.hostname(x) == identity.hostname(F.col("url"))) & gate.posting_path(x))
    return F.size(F.array_distinct(F.transform(mine, urls.frontier_url)))


def gate_facts(facts: DataFrame) -> DataFrame:
    """Facts of pages for the gates: ``n_links`` to postings, ``embed`` of a board, ``openings_index`` and ``lone`` posting in
    structured data."""
    return facts.withColumns({
        "n_links": posting_links(facts), "embed": identity.has_board_embed(F.col("embeds"), F.col("element_ids")),
        "openings_index": F.col("posting.openings_index"), "lone": F.col("posting.stratum") == "lone"})


def posting_body(posting: Column, main_content: Column, most: int = K.POSTING_BODY_CHARS) -> Column:
    """struct(body, source): the description of a page's only posting if it has one, else the page's flattened text; at most so
    many characters, the default for a limit that is not positive. What could not be decoded is dropped."""
    most = most if most > 0 else K.POSTING_BODY_CHARS
    alone = (posting["postings"] == 1) & ~posting["openings_index"]
    declared = F.when(alone, F.nullif(posting["description"], F.lit("")))
    cut = lambda c: F.left(F.translate(c, "�", ""), F.lit(most))
    return F.struct(cut(F.coalesce(declared, flattened_text(F.coalesce(main_content, F.lit(""))))).alias("body"), F.when(declared.isNotNull(), "structured_data").otherwise("page_content").alias("source"))


def free_extractions(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings, others) of pages: listings (page_id, url, title, location, country_hint, work_arrangement) that structured data
    tells without a model, being the page's only posting, with a title, and not withdrawn; the other pages go to a model."""
    body = flattened_text(F.coalesce("main_content", F.lit("")))
    free = (F.col("posting.stratum") == "lone") & (F.col("posting.title") != "") & ~gate.withdrawn(body, F.col("posting.description"))
    marked = facts.withColumn("free_", F.coalesce(free, F.lit(False)))
    listings = marked.filter("free_").select(
        "page_id", "url", F.col("posting.title").alias("title"), F.col("posting.location").alias("location"), F.col("posting.country").alias("country_hint"),
        F.when(F.col("posting.remote"), "remote").otherwise("unspecified").alias("work_arrangement"))
    return listings, marked.filter("NOT free_").drop("free_")


def lenient_json(answer: Column) -> Column:
    """The JSON object in a model's answer: without what it thought, code fences, and whatever stands around the outermost
    braces; null if there are none, or if that is no JSON."""
    said = F.regexp_replace(answer, r"(?s)<think>.*?</think>", "")
    inner = F.regexp_extract(said, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner)
