"""Scores of whole pipelines, reviews of labels, and reports of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.operators.evaluate import confusion, rate


def with_verdicts(rows: DataFrame) -> DataFrame:
    """Rows (url, category, positive, verified, outcome, votes) with ``vote`` (the majority of the model's votes, a tie is
    yes, none is no), ``unanimous`` and ``predicted``: what the gate is certain of, else the vote."""
    yes, n = F.size(F.filter("votes", lambda v: v)), F.coalesce(F.size("votes"), F.lit(0))
    vote = (n > 0) & (2 * yes >= n)
    rows = rows.withColumns({"n_votes": F.greatest(n, F.lit(0)), "vote": F.coalesce(vote, F.lit(False)), "unanimous": F.coalesce((yes == 0) | (yes == n), F.lit(True))})
    return rows.withColumn("predicted", F.when(F.col("outcome") == "certain_accept", True).when(F.col("outcome") == "uncertain", F.col("vote")).otherwise(False))


def vote_scorecard(rows: DataFrame) -> DataFrame:
    """One row: the confusion of the majority over rows with votes, and the share of those whose votes differ."""
    voted = with_verdicts(rows).filter("n_votes > 0")
    flips = voted.agg(F.count_if(~F.col("unanimous")).alias("flips"), F.count("*").alias("n")).select("flips", rate(F.col("flips"), F.col("n")).alias("flip_rate"))
    return confusion(voted, F.col("positive"), F.col("vote")).join(F.broadcast(flips))  # two single rows


def end_to_end(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The confusion of what the whole pipeline says, over all or by category."""
    return confusion(with_verdicts(rows), F.col("positive"), F.col("predicted"), by)


def review_queue(rows: DataFrame) -> DataFrame:
    """(url, category, positive, reasons) of rows that nobody has verified and whose label the gate, where it is certain,
    or the pipeline, where it has a verdict, contradicts."""
    r = with_verdicts(rows).filter(~F.coalesce("verified", F.lit(False)))
    gate = F.when(F.col("outcome") != "uncertain", F.col("outcome") == "certain_accept")
    spoken = (F.col("outcome") != "uncertain") | (F.col("n_votes") > 0)
    reasons = F.array_compact(F.array(F.when(gate != F.col("positive"), "gate"), F.when(spoken & (F.col("predicted") != F.col("positive")), "pipeline")))
    return r.select("url", "category", "positive", reasons.alias("reasons")).filter(F.size("reasons") > 0)


def boundary_scorecard(rows: DataFrame) -> DataFrame:
    """One row of rows (url, label, extract, confirmed): how many are read, skipped, confirmed; skips of ambiguous rows; skips
    of postings; rows of each label, also of labels that do not occur."""
    n = lambda c, name: F.count_if(c).alias(name)
    skipped, label = ~F.col("extract"), F.col("label")
    return rows.agg(
        F.count("*").alias("rows"), n(F.col("extract"), "extracted"), n(skipped, "skipped"), n(F.col("confirmed"), "confirmed"), n(~F.col("confirmed"), "unconfirmed"),
        n(skipped & (label == "ambiguous"), "ambiguous_skipped"), n(skipped & (label == "detail"), "false_drops"), *[n(label == x, "n_" + x.replace("-", "_")) for x in ("detail", "hub-index", "residue", "ambiguous")])


def boundary_disagreements(rows: DataFrame) -> DataFrame:
    """(url, side) of rows (url, before, after, verdict) that two configurations decide differently: accept or abstain by the
    verdict at the time where the new one skips what the old one read, reversed where it is the other way round."""
    side = F.when(F.col("after"), "reversed").when(F.col("verdict"), "accept").otherwise("abstain")
    return rows.filter("before <> after").select("url", side.alias("side"))


def excluding(candidates: DataFrame, committed: DataFrame) -> DataFrame:
    """Candidates (url, ..) whose URL is not among those committed before."""
    return candidates.join(committed.select("url"), "url", "left_anti").select(candidates.columns)


def label_agreement(rows: DataFrame, labels: list[str], tolerance: float = 1e-6) -> DataFrame:
    """One row of rows (label, proposed_label, confirmed_by, weight): how many confirmed labels are those proposed, of how
    many with both; the sum of weights, and whether it is the number of rows."""
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    both = said("confirmed_by") & said("proposed_label") & F.col("label").isin(labels)
    return rows.agg(
        F.count_if(both & (F.col("proposed_label") == F.col("label"))).alias("agreed"), F.count_if(both).alias("comparable"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"),
        (F.abs(F.coalesce(F.sum("weight"), F.lit(0.0)) - F.count("*")) <= tolerance).alias("balanced"))


def renderer_census(rows: DataFrame) -> DataFrame:
    """(renderer, n, words) of rows (renderer, rendering): how many pages and words came of each; no name is ``unstamped``."""
    from jobloom.functions.rendering import flattened_text

    name = F.coalesce(F.nullif("renderer", F.lit("")), F.lit("unstamped"))
    words = F.regexp_count(flattened_text(F.coalesce("rendering", F.lit(""))), F.lit(r"(?U)\S+"))
    return rows.groupBy(name.alias("renderer")).agg(F.count("*").alias("n"), F.sum(words).alias("words"))


def composition(rows: DataFrame, label: str, weight: Column, labels: list[str]) -> DataFrame:
    """(label, n, share): the weighted share of each of ``labels``, 0 of those that do not occur."""
    sums = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    every = rows.agg(F.sum(weight).alias("all")).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"), "all")
    return every.join(sums, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), rate(F.coalesce("w", F.lit(0.0)), F.coalesce("all", F.lit(0.0))).alias("share"))


def subsample(rows: DataFrame, label: str, order: str, n: int) -> DataFrame:
    """At most n rows of each label, at even steps in their order; all if n is not positive."""
    if n <= 0:
        return rows
    w = Window.partitionBy(label)
    ranked = rows.withColumn("at_", F.row_number().over(w.orderBy(order)) - 1).withColumn("all_", F.count("*").over(w))
    step = F.col("all_") / F.lit(float(n))
    # The row at place p is taken if p is the whole part of i * step for some i below n.
    first = F.ceil(F.col("at_") / step)
    near = F.array(*[first + k for k in (-1, 0, 1)])
    taken = F.exists(near, lambda i: (i >= 0) & (i < n) & (F.floor(i * step) == F.col("at_")))
    return ranked.filter((F.col("all_") <= n) | taken).drop("at_", "all_")


def extraction_report(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of results (url, label, error, is_posting, title, location, work_arrangement) against expected fields
    (url, title, location, work_arrangement): recall, what is shed of each class, precision and F1 in percent, and how many
    fields are as expected. Results with an error count as errors alone."""
    pct = lambda n, d: F.round(F.coalesce(F.try_divide(100.0 * n, d), F.lit(0.0)), 1)
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))
    e = expected.select("url", F.struct("title", "location", "work_arrangement").alias("want"))
    r = rows.join(e, "url", "left").withColumn("ok", F.coalesce("error", F.lit("")) == "")
    kept, ok = F.col("ok") & F.col("is_posting"), F.col("ok")
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    compared = kept & F.col("want").isNotNull()
    same = lambda c: compared & (norm(F.col(c)) == norm(F.col("want." + c)))
    detail, hub = F.col("label") == "detail", F.col("label") == "hub-index"
    s = r.agg(
        n(ok, "scored"), n(~ok, "errors"), n(ok & detail, "details"), n(kept & detail, "tp"), n(kept & ~detail, "fp"), n(ok & hub, "hubs"), n(ok & hub & ~F.col("is_posting"), "hubs_shed"),
        n(ok & ~detail & ~hub, "residue"), n(ok & ~detail & ~hub & ~F.col("is_posting"), "residue_shed"), n(compared, "compared"), *[n(same(c), c + "_same") for c in ("title", "location", "work_arrangement")])
    c = F.col
    p, q = F.coalesce(F.try_divide(100.0 * c("tp"), c("tp") + c("fp")), F.lit(0.0)), F.coalesce(F.try_divide(100.0 * c("tp"), c("details")), F.lit(0.0))
    return s.select(
        "scored", "errors", "tp", "fp", pct(c("tp"), c("details")).alias("recall"), pct(c("hubs_shed"), c("hubs")).alias("hub_shed"), pct(c("residue_shed"), c("residue")).alias("residue_shed"),
        F.round(p, 1).alias("precision"), F.round(F.coalesce(F.try_divide(2 * p * q, p + q), F.lit(0.0)), 1).alias("f1"), pct(c("tp") + c("fp"), c("scored")).alias("save_rate"), "compared",
        *[pct(c(x + "_same"), c("compared")).alias(x + "_exact") for x in ("title", "location", "work_arrangement")])


def stage_summary(events: DataFrame) -> DataFrame:
    """(kind, calls, errors, timeouts, gated, abstains, and their rates) of a model's stages from events (kind, event), event
    being call, error, timeout, gated, seen, dup, retry, deadletter, abstain; shadow verdicts are shadow_accept and
    shadow_abstain."""
    n = lambda e: F.count_if(F.col("event") == e)
    names = {"call": "calls", "error": "errors", "timeout": "timeouts", "gated": "gated", "retry": "retries", "deadletter": "deadletters", "abstain": "abstains", "seen": "seen", "dup": "dups", "shadow_accept": "shadow_accepts", "shadow_abstain": "shadow_abstains"}
    s = events.groupBy("kind").agg(*[n(e).alias(name) for e, name in names.items()])
    c = F.col
    return s.select(
        "*", rate(c("gated"), c("gated") + c("calls")).alias("gate_hit_rate"), rate(c("errors"), c("calls")).alias("error_rate"), rate(c("timeouts"), c("calls")).alias("timeout_rate"),
        rate(c("dups"), c("seen")).alias("dup_ratio"), rate(c("abstains"), c("calls")).alias("empty_extraction_rate"), rate(c("shadow_accepts"), c("shadow_accepts") + c("shadow_abstains")).alias("shadow_false_drop_rate"))


def repeated_contents(seen: DataFrame, ttl_days: int = 7) -> DataFrame:
    """(kind, seen, dups, dup_ratio) of contents (kind, at, text): one counts as repeated if its kind has had the whole
    text before, and the set of what was seen has not run out since; each sighting of the kind renews the set."""
    w = Window.partitionBy("kind").orderBy("at", "hash")
    rows = seen.select("kind", "at", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    gap = F.unix_micros("at") - F.unix_micros(F.lag("at").over(w)) > F.lit(ttl_days * 86_400_000_000)
    epochs = rows.withColumn("epoch", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    firsts = epochs.groupBy("kind", "epoch", "hash").agg(F.count("*").alias("n"))
    s = firsts.groupBy("kind").agg(F.sum("n").alias("seen"), F.sum(F.col("n") - 1).alias("dups"))
    return s.select("kind", "seen", "dups", rate(F.col("dups"), F.col("seen")).alias("dup_ratio"))
