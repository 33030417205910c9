"""Sightings, board ingest and refetch: what a cycle does to the catalog and the corpus.

Everything is a function from snapshots and what has been fetched to new snapshots. Fetching
itself is not here: boards, pages and listings come with their status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import constants as K
from jobloom.functions import identity, urls
from jobloom.functions.geo import hinted
from jobloom.operators import edits, state
from jobloom.operators.gate import is_hub_or_root


def _empty_is_null(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def _upsert(old: DataFrame, seen: DataFrame, keys: list[str], fresh: dict[str, Column], kept: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``old`` with rows of ``seen`` by key. ``fresh`` says what a row that is seen gets; ``kept`` what others get,
    and what a row that is both new and seen gets."""
    o, s = old.withColumn("in_old_", F.lit(True)).alias("o"), seen.withColumn("in_seen_", F.lit(True)).alias("s")
    match = F.lit(True)
    for k in keys:
        match = match & (F.col("o." + k) == F.col("s." + k))
    is_seen, is_old = F.col("s.in_seen_").isNotNull(), F.col("o.in_old_").isNotNull()
    out = {k: F.coalesce("o." + k, "s." + k) for k in keys}
    out |= {c: F.when(is_seen, e).otherwise(F.col("o." + c)) for c, e in fresh.items()}
    out |= {c: F.when(is_old, e).otherwise(new) for c, (e, new) in kept.items()}
    return o.join(s, match, "full").select(*[out[c].alias(c) for c in old.columns])


def sight_companies(companies: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Companies (company_key, ats_provider, display_domain, name, name_source, website, first_seen,
    last_seen) after sightings (company_key, ats_provider, display_domain, name, name_source, seq). A
    sighting overwrites what it says and is last_seen; first_seen and website stay. Empty provider and name
    source are null. Of several sightings of a company the last by seq holds."""
    last = state.latest(seen, ["company_key"], F.desc("seq")).drop("seq")
    last = last.withColumn("ats_provider", _empty_is_null("ats_provider")).withColumn("name_source", _empty_is_null("name_source"))
    fresh = {c: F.col("s." + c) for c in ("ats_provider", "display_domain", "name", "name_source")} | {"last_seen": now}
    kept = {"website": (F.col("o.website"), F.lit(None).cast("string")), "first_seen": (F.col("o.first_seen"), now)}
    return _upsert(companies, last, ["company_key"], fresh, kept)


def sight_pages(pages: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Career pages (company_id, url, politeness_domain, first_seen, last_seen, consecutive_failures, last_ok)
    after sightings (company_id, url, politeness_domain). A page seen again is awake: no failures, last_ok now; a
    new one has not been probed yet."""
    last = seen.groupBy("company_id", "url").agg(F.max("politeness_domain").alias("politeness_domain"))
    is_old = F.col("o.in_old_").isNotNull()
    fresh = {"politeness_domain": F.col("s.politeness_domain"), "last_seen": now, "consecutive_failures": F.lit(0).cast(dict(pages.dtypes)["consecutive_failures"]), "last_ok": F.when(is_old, now)}
    return _upsert(pages, last, ["company_id", "url"], fresh, {"first_seen": (F.col("o.first_seen"), now)})


def merge_pages(pages: DataFrame, file: DataFrame, now: Column) -> DataFrame:
    """Career pages after an import (company_id, url, politeness_domain, first_seen, last_seen): spans of sight
    only widen, and by the file's times alone; a new page without times is seen now, and not first seen after it was
    last seen. An import is no sighting: it wakes no page."""
    f = lambda c: F.col("s." + c)
    in_file = F.col("s.in_seen_").isNotNull()
    last_new = F.coalesce(f("last_seen"), now)
    fresh = {"politeness_domain": f("politeness_domain")}
    kept = {
        "first_seen": (F.when(in_file, F.least("o.first_seen", f("first_seen"))).otherwise(F.col("o.first_seen")), F.least(F.coalesce(f("first_seen"), now), last_new)),
        "last_seen": (F.when(in_file, F.greatest("o.last_seen", f("last_seen"))).otherwise(F.col("o.last_seen")), last_new),
        "consecutive_failures": (F.col("o.consecutive_failures"), F.lit(0).cast(dict(pages.dtypes)["consecutive_failures"])), "last_ok": (F.col("o.last_ok"), F.lit(None).cast("timestamp"))}
    one = file.groupBy("company_id", "url").agg(F.max("politeness_domain").alias("politeness_domain"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return _upsert(pages, one, ["company_id", "url"], fresh, kept)


def reattribute_pages(pages: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, refused) after ``moves`` (page_id, to_company_id): only the owner changes. A move is refused where
    the new owner has a page of that URL already, or would get it twice. Pages that do not exist change nothing."""
    want = pages.join(moves.select("page_id", "to_company_id"), "page_id").filter("to_company_id <> company_id").select("page_id", "url", "to_company_id")
    taken = pages.select(F.col("company_id").alias("to_company_id"), "url")
    first = want.groupBy("to_company_id", "url").agg(F.min("page_id").alias("page_id")).join(taken, ["to_company_id", "url"], "left_anti")
    moved = pages.join(first.select("page_id", "to_company_id"), "page_id", "left").withColumn("company_id", F.coalesce("to_company_id", "company_id")).select(pages.columns)
    return moved, want.join(first.select("page_id"), "page_id", "left_anti")


def delete_companies(companies: DataFrame, pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Companies without those of ``gone`` (company_id) that no page belongs to any more."""
    free = gone.select("company_id").join(pages.select("company_id"), "company_id", "left_anti")
    return companies.join(free, "company_id", "left_anti").select(companies.columns)


# --- seeds ----------------------------------------------------------------------------------


def route_seeds(seeds: DataFrame, fetchers: list[str]) -> DataFrame:
    """(lane, url, scope, owner, provider, tenant, career_page_id) of seeds (url, company_key, career_page_id): a
    page on a board that has a fetcher is read there (``board``); all others are walked (``crawl``), and if they
    are career pages refetched as well (``refetch``). Seeds whose URL names no company are dropped."""
    rows = identity.with_once(seeds, board_=identity.board(F.col("url")))
    b = F.col("board_")
    rows = identity.with_once(rows, who_=identity.identify(F.col("url"), b))
    on_board = F.col("who_.provider").isin(fetchers)
    lanes = F.when(on_board, F.array(F.lit("board"))).when(F.col("career_page_id").isNotNull(), F.array(F.lit("crawl"), F.lit("refetch"))).otherwise(F.array(F.lit("crawl")))
    rows = rows.filter(F.coalesce("who_.company_key", F.lit("")) != "").select("*", F.explode(lanes).alias("lane"))
    mine = F.col("lane") == "board"
    return rows.select(
        "lane", "url", F.col("who_.company_key").alias("scope"), F.col("company_key").alias("owner"), F.when(mine, F.col("who_.provider")).alias("provider"),
        F.when(mine, b["slug"]).alias("tenant"), "career_page_id")


def one_task_per_tenant(tasks: DataFrame) -> DataFrame:
    """Board tasks (provider, tenant, seq, ..), each tenant once: the first by seq."""
    return state.latest(tasks, ["provider", "tenant"], F.asc("seq"))


def seed_visited(listings: DataFrame, pages: DataFrame) -> DataFrame:
    """(url) of the open listings of ``pages`` (career_page_id): what a walk need not visit to find new ones."""
    open_ = listings.filter("closed_at IS NULL").join(pages.select("career_page_id").distinct(), "career_page_id", "left_semi")
    return open_.select("url").distinct()


# --- boards ---------------------------------------------------------------------------------


def fetch_outcome(status: Column) -> Column:
    """What a fetch says of what was fetched: alive with 200, dead with 404 and 410, else inconclusive."""
    return F.when(status == 200, "alive").when(status.isin(404, 410), "dead").otherwise("inconclusive")


def board_listings(tasks: DataFrame, feed: DataFrame, companies: DataFrame, resolved: DataFrame, iso_codes: list[str]) -> DataFrame:
    """Feed rows (provider, tenant, and the columns of a feed) as corpus rows of their task's owner: company name,
    country by hint and location, identity by the board's own id, else by the URL. ``resolved`` (location, country)
    has the locations and the hints."""
    rows = feed.join(tasks.select("provider", "tenant", "owner", "career_page_id"), ["provider", "tenant"])
    rows = rows.join(companies.select(F.col("company_key").alias("owner"), F.col("name").alias("company")), "owner", "left")
    rows = rows.join(resolved.select("location", F.col("country").alias("by_place_")), "location", "left").join(resolved.select(F.col("location").alias("country_hint"), F.col("country").alias("by_hint_")), "country_hint", "left")
    own = F.when(F.col("source_id") != "", urls.ats_listing_id(F.col("provider"), F.col("tenant"), F.col("source_id"))).otherwise(urls.listing_url(F.col("url")))
    return rows.select(
        own.alias("canonical_url"), "url", F.lit("ats").alias("source"), "career_page_id", "company", F.col("owner").alias("company_key"), "title", F.col("body").alias("description"), F.lit("ats_board").alias("description_source"),
        "location", F.coalesce(hinted(F.col("country_hint"), F.col("by_hint_"), F.col("by_place_"), iso_codes), F.lit("")).alias("country"), "work_arrangement", "department")


def ingest_boards(listings: DataFrame, tasks: DataFrame, found: DataFrame, boards: DataFrame, now: Column, cycle_start: Column) -> tuple[DataFrame, DataFrame]:
    """(listings, probes) after boards have been read. ``found`` has the columns of ``listings`` but for times and
    streaks; ``boards`` (provider, tenant, status, complete) what became of each task (provider, tenant, career_page_id).

    What a board holds is saved. Listings of its page that a complete board no longer holds are closed; a board that is
    incomplete closes nothing, one that failed changes nothing. ``probes`` (page_id, outcome) say how the page fared."""
    done = tasks.join(boards, ["provider", "tenant"])
    read = done.filter("status = 200")
    saved = state.upsert_listings(listings, found.withColumn("discovered_depth", F.lit(None).cast("int")).withColumn("seq", F.col("url")), now)
    closed = state.close_absent(saved, read.select(F.col("career_page_id"), "complete"), cycle_start, now)
    probes = done.filter("career_page_id IS NOT NULL").groupBy(F.col("career_page_id").alias("page_id")).agg(F.min(fetch_outcome(F.col("status"))).alias("outcome"))
    return closed.select(listings.columns), probes


# --- refetch --------------------------------------------------------------------------------


def page_outcome(status: Column, still_career_page: Column) -> Column:
    """Of a page that was fetched: alive if it is a career page still, dead if not, inconclusive if nobody could say."""
    read = F.when(still_career_page.isNull(), "inconclusive").when(still_career_page, "alive").otherwise("dead")
    return F.when(status == 200, read).otherwise(fetch_outcome(status))


def refetch(pages: DataFrame, fetched_pages: DataFrame, listings: DataFrame, fetched: DataFrame, now: Column, stale: int = K.LIVENESS_THRESHOLD, dormant: int = K.DORMANCY_THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, listings, again) after a pass over pages (page_id, consecutive_failures, last_ok, ..) by what was fetched.

    ``fetched_pages`` (page_id, status, still_career_page) are probes of pages; one that makes its page dormant closes
    the page's listings. Of the other probed pages, each open listing is probed: dead if its URL is an index, by its
    status if it was not read, inconclusive if it could not be parsed, alive if its text is the same; a changed text says
    nothing, and goes to ``again`` (canonical_url, url) if it can still be extracted. Of a listing with the same text whose
    description a model made before, the description becomes the page's. ``fetched`` has canonical_url, status,
    parsed, source_hash, extractable, body, body_source."""
    probes = fetched_pages.select("page_id", page_outcome(F.col("status"), F.col("still_career_page")).alias("outcome"))
    probed = edits.record_probes(pages, probes, now, dormant)
    closed = edits.close_dormant(listings, probed, now)
    awake = probed.join(probes.select("page_id"), "page_id", "left_semi").filter("NOT became_dormant").select(F.col("page_id").alias("career_page_id"))
    due = closed.filter("closed_at IS NULL").join(awake, "career_page_id", "left_semi")
    seen = due.select("canonical_url", "url", "description_source", F.col("source_hash").alias("known_hash_")).join(fetched, "canonical_url", "left")
    index = is_hub_or_root(F.col("url")) & ~F.coalesce(identity.role(F.col("url")) == "job_listing", F.lit(False))
    same = F.coalesce(F.col("source_hash") == F.col("known_hash_"), F.lit(False))
    outcome = (
        F.when(index, "dead").when(F.coalesce(F.col("status"), F.lit(0)) != 200, fetch_outcome(F.coalesce("status", F.lit(0)))).when(~F.coalesce("parsed", F.lit(False)), "inconclusive").when(same, "alive"))
    seen = seen.withColumn("outcome", outcome)
    after = edits.apply_probes(closed, seen.filter("outcome IS NOT NULL").select("canonical_url", "outcome"), now, stale)
    heal = seen.filter((F.col("outcome") == "alive") & (F.col("description_source") == "llm_summary") & (F.coalesce("body", F.lit("")) != ""))
    after = edits.update_descriptions(after, heal.select("canonical_url", F.col("body").alias("description"), F.col("body_source").alias("description_source")))
    again = seen.filter(F.col("outcome").isNull() & F.col("extractable")).select("canonical_url", "url")
    return probed.drop("became_dormant"), after, again
