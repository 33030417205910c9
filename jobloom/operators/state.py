"""Catalog and corpus changes as pure functions from an old snapshot and changes to a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions import constants as K


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in this order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def upsert_listings(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Listings saved again are refreshed, opened, and seen now; first_seen and depth stay.

    ``new`` has the columns of ``old`` but for first_seen, last_seen, closed_at and inconclusive_streak, and seq,
    by which the last of several rows of one listing holds."""
    new = latest(new, ["canonical_url"], F.desc("seq")).drop("seq").withColumn("in_new", F.lit(True))
    o, n = old.withColumn("in_old", F.lit(True)).alias("o"), new.alias("n")
    is_new, is_old = F.col("n.in_new").isNotNull(), F.col("o.in_old").isNotNull()
    own = {
        "canonical_url": F.coalesce("o.canonical_url", "n.canonical_url"),
        "discovered_depth": F.when(is_old, F.col("o.discovered_depth")).otherwise(F.when(F.col("n.source") == "crawl", F.col("n.discovered_depth"))),
        "first_seen": F.coalesce("o.first_seen", now), "last_seen": F.when(is_new, now).otherwise(F.col("o.last_seen")),
        "closed_at": F.when(~is_new, F.col("o.closed_at")), "inconclusive_streak": F.when(is_new, 0).otherwise(F.col("o.inconclusive_streak"))}
    pick = lambda c: F.when(is_new, F.col("n." + c)).otherwise(F.col("o." + c))
    return o.join(n, F.col("o.canonical_url") == F.col("n.canonical_url"), "full").select(*[(own[c] if c in own else pick(c)).alias(c) for c in old.columns])


def merge_companies(old: DataFrame, file: DataFrame) -> DataFrame:
    """An import into the companies: what the file has wins, spans of sight only widen, and
    a changed name loses its source. A new company is not first seen after it was last seen."""
    o, f = old.alias("o"), file.alias("f")
    both = F.col("o.company_key").isNotNull() & F.col("f.company_key").isNotNull()
    name = F.coalesce("f.name", "o.name")
    renamed = F.col("f.name").isNotNull() & ~F.col("f.name").eqNullSafe(F.col("o.name"))
    least = F.least("f.first_seen", F.when(F.col("o.company_key").isNull(), F.col("f.last_seen")).otherwise(F.col("o.first_seen")))
    return o.join(f, F.col("o.company_key") == F.col("f.company_key"), "full").select(
        F.coalesce("o.company_key", "f.company_key").alias("company_key"), name.alias("name"), F.coalesce("f.website", "o.website").alias("website"),
        F.when(both & renamed, F.lit(None)).otherwise(F.col("o.name_source")).alias("name_source"),
        F.when(F.col("f.company_key").isNull(), F.col("o.first_seen")).otherwise(least).alias("first_seen"), F.greatest("o.last_seen", "f.last_seen").alias("last_seen"))


def close_absent(listings: DataFrame, boards: DataFrame, watermark: Column, now: Column) -> DataFrame:
    """Close the open feed listings of pages that a complete reading has not seen since. ``boards``
    (career_page_id, complete) has all pages that were read; one of several readings that is incomplete closes nothing."""
    whole = boards.groupBy("career_page_id").agg(F.bool_and("complete").alias("whole_"))
    gone = F.col("whole_") & (F.col("source") == "ats") & F.col("closed_at").isNull() & (F.col("last_seen") < watermark)
    joined = listings.join(whole, "career_page_id", "left")
    return joined.withColumn("closed_at", F.when(gone, now).otherwise(F.col("closed_at"))).select(listings.columns)


def attribute_by_prefix(postings: DataFrame, pages: DataFrame) -> DataFrame:
    """(company_key, posting_url, page_url): of the pages of the posting's company that whose URL is the
    longest prefix of it up to a path boundary; without any, the first by ``pos``.

    A posting has few prefixes that end at a boundary, however many pages its company has: each becomes a row and is
    joined by equality, so the work is that of the postings, not of postings times pages."""
    url = F.col("posting_url")
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(url), F.lit(1))), lambda i: (i == F.length(url)) | (F.substring(url, i, F.lit(1)) == "/") | (F.substring(url, i + 1, F.lit(1)) == "/"))
    prefixes = postings.select("company_key", "posting_url", F.explode_outer(F.array_distinct(F.transform(at, lambda i: F.substring(url, F.lit(1), i)))).alias("page_url"))
    first = pages.groupBy("company_key", "page_url").agg(F.min("pos").alias("pos"))
    hits = prefixes.join(first.select("company_key", "page_url"), ["company_key", "page_url"]).groupBy("company_key", "posting_url").agg(F.max_by("page_url", F.length("page_url")).alias("page_url"))
    default = pages.groupBy("company_key").agg(F.min(F.struct("pos", "page_url"))["page_url"].alias("default_"))
    rows = postings.select("company_key", "posting_url").distinct().join(hits, ["company_key", "posting_url"], "left").join(default, "company_key", "left")
    return rows.select("company_key", "posting_url", F.coalesce("page_url", "default_").alias("page_url"))


#: Times are folded into spans of this length first, so that a much-probed key is many small groups.
FOLD_SECONDS = 3600


def _since_last(probes: DataFrame, resets: Column, counted: Column) -> DataFrame:
    """(key, last, n, n_all): the last probe (at, outcome) that resets, and how many counted probes came after it.

    Probes are shuffled once, by key and span of time: each span is reduced to its own last reset and what
    came after that, and the few rows of spans then to those of keys."""
    seconds = F.unix_seconds(F.col("at").cast("timestamp")) if dict(probes.dtypes)["at"].startswith("timestamp") else F.col("at").cast("long")
    span = F.floor(seconds / FOLD_SECONDS)
    rows = probes.select("key", span.alias("span"), "at", "outcome", resets.alias("resets"), counted.alias("counted"))
    at = rows.groupBy("key", "span", "at").agg(F.max(F.when(F.col("resets"), F.struct("at", "outcome"))).alias("last"), F.count_if("counted").alias("n"))
    parts = at.groupBy("key", "span").agg(F.max("last").alias("last"), F.collect_list(F.struct("at", "n")).alias("ns"))
    after = lambda xs, last: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.when(last.isNull() | (x["at"] > last["at"]), x["n"]).otherwise(0))
    parts = parts.select("key", "span", "last", after(F.col("ns"), F.col("last")).alias("n"))
    spans = parts.groupBy("key").agg(F.max("last").alias("last"), F.max(F.when(F.col("last").isNotNull(), F.col("span"))).alias("last_span"), F.collect_list(F.struct("span", "n")).alias("ns"))
    n = F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + F.when(F.col("last_span").isNull() | (x["span"] >= F.col("last_span")), x["n"]).otherwise(0))
    return spans.select("key", "last", n.alias("n"))


def fold_liveness(probes: DataFrame, threshold: int = K.LIVENESS_THRESHOLD) -> DataFrame:
    """(key, open, streak) after all probes (key, at, outcome, complete) in order of time.

    Alive opens and resets; dead closes and resets if the reading was complete; the others
    count, and close at the threshold unless that is not positive. Only the last probe that
    resets and the number of inconclusive ones after it matter; of probes at one time those that reset come last."""
    # Of equal times alive is decided last, by its name.
    reset = (F.col("outcome") == "z alive") | ((F.col("outcome") == "dead") & F.col("complete"))
    ranked = probes.withColumn("outcome", F.when(F.col("outcome") == "alive", "z alive").otherwise(F.col("outcome")))
    done = _since_last(ranked, F.coalesce(reset, F.lit(False)), F.col("outcome") == "inconclusive")
    crossed = F.lit(threshold > 0) & (F.col("n") >= threshold)
    return done.select("key", ((F.col("last").isNull() | (F.col("last.outcome") == "z alive")) & ~crossed).alias("open"), F.col("n").alias("streak"))


def fold_dormancy(probes: DataFrame, threshold: int = K.DORMANCY_THRESHOLD) -> DataFrame:
    """(key, failures, last_ok, dormant): dead probes since the last alive one."""
    done = _since_last(probes, F.col("outcome") == "alive", F.col("outcome") == "dead")
    return done.select("key", F.col("n").alias("failures"), F.col("last.at").alias("last_ok"), (F.lit(threshold > 0) & (F.col("n") >= threshold)).alias("dormant"))


def insert_or_arbitrate(existing: DataFrame, submitted: DataFrame) -> DataFrame:
    """(key, verdict) of submissions (key, fingerprint): created, replay or conflict."""
    e = existing.select(F.col("key"), F.col("fingerprint").alias("known"))
    return submitted.join(e, "key", "left").select("key", F.when(F.col("known").isNull(), "created").when(F.col("known") == F.col("fingerprint"), "replay").otherwise("conflict").alias("verdict"))


def rate_limit_schedule(requests: DataFrame, interval: float) -> DataFrame:
    """(key, id, at, scheduled): each request waits for its turn, ``interval`` seconds after the
    one before of its key. scheduled_i = max over j <= i of at_j + (i - j) * interval."""
    w = Window.partitionBy("key").orderBy("at", "id")
    i = F.row_number().over(w)
    rows = requests.withColumn("i", i)
    start = F.max(F.col("at") - F.col("i") * interval).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("key", "id", "at", F.round(start + F.col("i") * interval, 3).alias("scheduled"))
