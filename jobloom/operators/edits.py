"""Edits of listings, pages and labels as functions from a snapshot to the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import constants as K


def apply_probes(listings: DataFrame, probes: DataFrame, now: Column, threshold: int = K.LIVENESS_THRESHOLD) -> DataFrame:
    """Listings after one probe each (canonical_url, outcome). Alive opens and is a sighting; dead
    closes; inconclusive counts and closes at the threshold unless that is not positive. One
    that is closed keeps the time at which it was closed. Others are untouched."""
    p = probes.select("canonical_url", F.col("outcome").alias("outcome_"))
    o, streak = F.col("outcome_"), F.col("inconclusive_streak")
    crossed = F.lit(threshold > 0) & (streak + 1 >= threshold)
    opened = F.when(o == "alive", True).when(o == "dead", False).otherwise(F.col("closed_at").isNull() & ~crossed)
    closed_at = F.when(o.isNull(), F.col("closed_at")).when(opened, None).otherwise(F.coalesce("closed_at", now))
    return listings.join(p, "canonical_url", "left").select(
        *[c for c in listings.columns if c not in ("closed_at", "last_seen", "inconclusive_streak")],
        F.when(o == "inconclusive", streak + 1).when(o.isNotNull(), 0).otherwise(streak).alias("inconclusive_streak"),
        closed_at.alias("closed_at"), F.when(o == "alive", now).otherwise(F.col("last_seen")).alias("last_seen")).select(listings.columns)


def unknown_keys(changes: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Changes of rows that do not exist; an edit leaves them out, and callers may object."""
    return changes.join(rows.select(key), key, "left_anti")


def record_probes(pages: DataFrame, probes: DataFrame, now: Column, threshold: int = K.DORMANCY_THRESHOLD) -> DataFrame:
    """Pages (page_id, consecutive_failures, last_ok, ..) after one probe each (page_id, outcome),
    with ``became_dormant``: whether this probe is the one that reached the threshold."""
    o, n = F.col("outcome_"), F.col("consecutive_failures")
    following = F.when(o == "alive", 0).when(o == "dead", n + 1).otherwise(n)
    dormant = lambda x: F.lit(threshold > 0) & (x >= threshold)
    joined = pages.join(probes.select("page_id", F.col("outcome").alias("outcome_")), "page_id", "left")
    rest = [c for c in pages.columns if c not in ("consecutive_failures", "last_ok")]
    out = joined.select(*rest, following.alias("consecutive_failures"), F.when(o == "alive", now).otherwise(F.col("last_ok")).alias("last_ok"), (~dormant(n) & dormant(following)).alias("became_dormant"))
    return out.select(*pages.columns, "became_dormant")


def close_dormant(listings: DataFrame, probed: DataFrame, now: Column) -> DataFrame:
    """Close the open listings, of either kind, of pages that have just become dormant."""
    asleep = probed.filter("became_dormant").select(F.col("page_id").alias("career_page_id"), F.lit(True).alias("asleep_"))
    joined = listings.join(asleep, "career_page_id", "left")
    return joined.withColumn("closed_at", F.when(F.col("asleep_") & F.col("closed_at").isNull(), now).otherwise(F.col("closed_at"))).select(listings.columns)


def update_descriptions(listings: DataFrame, bodies: DataFrame) -> DataFrame:
    """Set description and description_source from ``bodies`` (canonical_url, description,
    description_source); no other column changes."""
    b = bodies.select("canonical_url", F.struct("description", "description_source").alias("new_"))
    pick = lambda c: F.when(F.col("new_").isNotNull(), F.col("new_." + c)).otherwise(F.col(c)).alias(c)
    joined = listings.join(b, "canonical_url", "left")
    return joined.select(*[pick(c) if c in ("description", "description_source") else F.col(c) for c in listings.columns])


def delete_listings(listings: DataFrame, pages: DataFrame) -> DataFrame:
    """Listings without those of ``pages`` (page_id)."""
    return listings.join(pages.select(F.col("page_id").alias("career_page_id")), "career_page_id", "left_anti").select(listings.columns)


def repoint_listings(listings: DataFrame, moves: DataFrame) -> DataFrame:
    """Listings moved from page to page by ``moves`` (page_id, to_page_id); only the page changes."""
    m = moves.select(F.col("page_id").alias("career_page_id"), "to_page_id")
    return listings.join(m, "career_page_id", "left").withColumn("career_page_id", F.coalesce("to_page_id", "career_page_id")).select(listings.columns)


def sweep_interrupted(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs (.., status, finished_at) that a former process left pending or running have failed."""
    left = F.col("status").isin("pending", "running")
    return jobs.withColumn("finished_at", F.when(left, now).otherwise(F.col("finished_at"))).withColumn("status", F.when(left, "failed").otherwise(F.col("status")))


def append_seed(definitions: DataFrame, key: str, seed: str) -> DataFrame:
    """Add a seed URL to one definition (key, seed_urls, ..) unless it has it."""
    add = (F.col("key") == key) & ~F.array_contains("seed_urls", seed)
    return definitions.withColumn("seed_urls", F.when(add, F.array_append("seed_urls", F.lit(seed))).otherwise(F.col("seed_urls")))


def rename_searches(searches: DataFrame, names: DataFrame) -> DataFrame:
    """Saved searches (id, name, ..) with new names from ``names`` (id, name). Ids that do not exist
    change nothing; :func:`unknown_keys` finds them."""
    n = names.select("id", F.col("name").alias("name_"))
    return searches.join(n, "id", "left").withColumn("name", F.coalesce("name_", "name")).select(searches.columns)


def start_runs(runs: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Runs (run_id, definition, status, started_at) and a running one for each definition of ``wanted``
    (run_id, definition) that has none active; of several wanted for one the smallest run_id starts."""
    active = runs.filter(F.col("status").isin("running", "stopping", "pausing", "paused")).select("definition")
    one = wanted.groupBy("definition").agg(F.min("run_id").alias("run_id")).join(active, "definition", "left_anti")
    return runs.select("run_id", "definition", "status", "started_at").unionByName(one.select("run_id", "definition", F.lit("running").alias("status"), now.alias("started_at")))


def create_rows(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Saved searches or definitions with new ones added. Those whose key is taken change nothing; of
    several new ones with one key the first by all columns is added."""
    one = new.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("new_"))
    fresh = one.join(rows.select(key), key, "left_anti").select(key, "new_.*")
    return rows.unionByName(fresh)


def delete_rows(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Saved searches or definitions without those of ``gone``; keys that do not exist do no harm."""
    return rows.join(gone.select(key), key, "left_anti").select(rows.columns)


def create_definitions(definitions: DataFrame, new: DataFrame) -> DataFrame:
    """Definitions (id, kind, seed_urls, created_at, ..) with ``new``; absent seeds become an empty list. There is
    at most one of kind ``discovery``: of several the first by creation and id, and none if one exists."""
    rest = new.withColumn("seed_urls", F.coalesce("seed_urls", F.array().cast("array<string>")))
    discovery = F.col("kind") == "discovery"
    first = rest.filter(discovery).orderBy("created_at", "id").limit(1)
    taken = definitions.filter(discovery).limit(1).select("kind")
    return create_rows(definitions, rest.filter(~F.coalesce(discovery, F.lit(False))).unionByName(first.join(taken, "kind", "left_anti").select(rest.columns)))


#: Who labelled a row, and who confirmed it; empty strings where nobody has.
LABEL_COLUMNS = ["label", "proposed_label", "proposed_by", "proposed_at", "confirmed_by", "confirmed_at", "note"]


def apply_labels(rows: DataFrame, sheet: DataFrame, proposals: DataFrame, confirm: DataFrame, proposed_by: str = "", confirmed_by: str = "", stamp: str = "") -> DataFrame:
    """Gold rows (url, the ``LABEL_COLUMNS``, ..) after a human's sheet (url, label, note, proposed_by,
    confirmed_by) and then a model's proposals (url, label, note). ``confirm`` (url) lists the rows that
    ``confirmed_by`` signs.

    A new label takes back the confirmation of the old one. The first proposed label stays, also when a human overrides
    it; a row that came in confirmed never gets one. Nulls count as empty strings. URLs that are not
    among the rows change nothing; :func:`unknown_keys` finds them."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    s = sheet.select("url", F.struct(*[text(c).alias(c) for c in ("label", "note", "proposed_by", "confirmed_by")]).alias("sheet_"))
    p = proposals.select("url", F.struct(*[text(c).alias(c) for c in ("label", "note")]).alias("model_"))
    c = confirm.select("url", F.lit(True).alias("signs_")).distinct()
    out = rows.select(*[x for x in rows.columns if x not in LABEL_COLUMNS], *[text(x).alias(x) for x in LABEL_COLUMNS]).withColumn("was_confirmed_", text("confirmed_by") != "")
    out = out.join(s, "url", "left").join(p, "url", "left").join(c, "url", "left")
    open_to_proposal = (text("proposed_label") == "") & ~F.col("was_confirmed_") & (text("proposed_by") != "") & (text("label") != "")
    out = out.withColumn("proposed_label", F.when(open_to_proposal, F.col("label")).otherwise(F.col("proposed_label")))
    for change in ("sheet_", "model_"):
        told = F.col(change).isNotNull()
        label, note = F.col(change + ".label"), F.col(change + ".note")
        overturned = told & (F.col("confirmed_by") != "") & (F.col("label") != label)
        out = out.withColumns({
            "confirmed_by": F.when(overturned, "").otherwise(F.col("confirmed_by")), "confirmed_at": F.when(overturned, "").otherwise(F.col("confirmed_at")),
            "label": F.when(told, label).otherwise(F.col("label")), "note": F.when(told & (note != ""), note).otherwise(F.col("note"))})
        if change == "sheet_":
            signed = told & (F.col("sheet_.confirmed_by") != "") & (F.col("confirmed_by") == "")
            out = out.withColumns({
                "proposed_by": F.when(told & (F.col("sheet_.proposed_by") != ""), F.col("sheet_.proposed_by")).otherwise(F.col("proposed_by")),
                "confirmed_by": F.when(signed, F.col("sheet_.confirmed_by")).otherwise(F.col("confirmed_by")), "confirmed_at": F.when(signed, F.lit(stamp)).otherwise(F.col("confirmed_at"))})
    labelled = F.col("label") != ""
    proposes = labelled & F.lit(proposed_by != "") & (F.col("proposed_by") == "")
    out = out.withColumns({"proposed_by": F.when(proposes, F.lit(proposed_by)).otherwise(F.col("proposed_by")), "proposed_at": F.when(proposes, F.lit(stamp)).otherwise(F.col("proposed_at"))})
    still_open = labelled & (F.col("proposed_label") == "") & (F.col("confirmed_by") == "") & ~F.col("was_confirmed_") & (F.col("proposed_by") != "")
    signs = labelled & F.lit(confirmed_by != "") & (F.col("confirmed_by") == "") & F.coalesce("signs_", F.lit(False))
    out = out.withColumn("proposed_label", F.when(still_open, F.col("label")).otherwise(F.col("proposed_label")))
    out = out.withColumns({"confirmed_at": F.when(signs, F.lit(stamp)).otherwise(F.col("confirmed_at")), "confirmed_by": F.when(signs, F.lit(confirmed_by)).otherwise(F.col("confirmed_by"))})
    return out.select(rows.columns)
