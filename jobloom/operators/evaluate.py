"""Scorecards, samples, sessions and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(n: Column, d: Column) -> Column:
    """n by d to four places; 0 over 0."""
    return F.round(F.coalesce(F.try_divide(n.cast("double"), d), F.lit(0.0)), 4)


def confusion(rows: DataFrame, want: Column, got: Column, by: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall, accuracy, and F1 of the rounded precision and recall."""
    rows = rows.select(*(by or []), want.alias("w"), got.alias("g"))
    sums = rows.groupBy(*(by or [])).agg(
        F.count_if(F.col("w") & F.col("g")).alias("tp"), F.count_if(~F.col("w") & F.col("g")).alias("fp"),
        F.count_if(F.col("w") & ~F.col("g")).alias("fn"), F.count_if(~F.col("w") & ~F.col("g")).alias("tn"))
    c = F.col
    scored = sums.select("*", rate(c("tp"), c("tp") + c("fp")).alias("precision"), rate(c("tp"), c("tp") + c("fn")).alias("recall"), rate(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn")).alias("accuracy"))
    return scored.withColumn("f1", rate(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def majority(votes: DataFrame, key: str, vote: Column) -> DataFrame:
    """(key, verdict, unanimous, n): the majority; a tie is true."""
    v = votes.select(key, vote.alias("v"))
    return v.groupBy(key).agg((2 * F.count_if("v") >= F.count("*")).alias("verdict"), (F.count_distinct("v") == 1).alias("unanimous"), F.count("*").alias("n"))


def stratified_sample(rows: DataFrame, cell: list[str], url: str, seed: str, n: int) -> DataFrame:
    """The first n of each cell by the seeded hash of the URL; all if n is not positive."""
    if n <= 0:
        return rows
    h = F.sha2(F.concat(F.lit(seed + "\n"), F.col(url)), 256)
    w = Window.partitionBy(*cell).orderBy(h, url)
    return rows.withColumn("rn_", F.row_number().over(w)).filter(F.col("rn_") <= n).drop("rn_")


def weighted_stream(rows: DataFrame, weight: Column, called: Column, positive: Column) -> DataFrame:
    """Weighted call rate, precision and recall, and the effective number of rows."""
    w = rows.select(weight.alias("w"), called.alias("c"), positive.alias("p"))
    total = w.agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("s2"), F.sum(F.when(F.col("c"), F.col("w")).otherwise(0)).alias("called"),
        F.sum(F.when(F.col("p"), F.col("w")).otherwise(0)).alias("positive"), F.sum(F.when(F.col("c") & F.col("p"), F.col("w")).otherwise(0)).alias("hit"))
    c = F.col
    return total.select(F.round("s", 4).alias("weight"), F.round(F.coalesce(F.try_divide(c("s") * c("s"), c("s2")), F.lit(0.0)), 1).alias("effective_n"),
        rate(c("called"), c("s")).alias("call_rate"), rate(c("hit"), c("called")).alias("precision"), rate(c("hit"), c("positive")).alias("recall"))


def sessions(rows: DataFrame, key: str, order: str, ts: str, gap_seconds: float) -> DataFrame:
    """``rows`` with the number of their session: a longer gap to the row before starts one."""
    w = Window.partitionBy(key).orderBy(order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    starts = rows.withColumn("starts_", F.when(gap > F.lit(int(gap_seconds * 1e6)), 1).otherwise(0))
    return starts.withColumn("session", F.sum("starts_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("starts_")


def corrected_prefix(rows: DataFrame, keys: list[str], idx: str, verdict: Column) -> DataFrame:
    """The rows up to the earlier of the last accept and the last abstain of their session; none
    of a session that lacks one of them."""
    w = Window.partitionBy(*keys)
    last = lambda c: F.coalesce(F.max(F.when(c, F.col(idx))).over(w), F.lit(-1))
    return rows.withColumn("upto_", F.least(last(verdict), last(~verdict))).filter(F.col(idx) <= F.col("upto_")).drop("upto_")


def growth(rows: DataFrame, ts: str, end: Column, max_points: int) -> DataFrame:
    """(day, total): days without rows filled in, running totals, thinned to about max_points
    with the last day kept. The windows run over one row per day."""
    days = rows.groupBy(F.date_trunc("day", ts).alias("day")).agg(F.count("*").alias("n"))
    span = days.agg(F.min("day").alias("a"), F.greatest(F.max("day"), F.date_trunc("day", end)).alias("b")).filter("a IS NOT NULL")
    every = span.select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day"))
    w = Window.orderBy("day")
    total = every.join(days, "day", "left").select("day", F.sum(F.coalesce("n", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("total"), (F.row_number().over(w) - 1).alias("i"))
    if max_points < 1:
        return total.select("day", "total")
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    kept = total.withColumn("n", n).filter((F.col("i") % F.ceil(F.col("n") / max_points) == 0) | (F.col("i") == F.col("n") - 1))
    return kept.select("day", "total")


def ledger_audit(observed: DataFrame, ledger: DataFrame) -> DataFrame:
    """(url, finding) of observed drops (url, rung, confirmed) against a ledger (url, rung, confirmed, reason, seq),
    of whose entries of one URL the first by seq holds. A URL may have several findings: a drop is unrecorded, or its entry
    names another rung (misattributed) or another standing (restanding); an entry has no reason (unargued), stands twice
    (duplicated), or is no drop any more (recovered); without any finding it is standing."""
    entry = ledger.groupBy("url").agg(F.count("*").alias("n"), F.min(F.struct("seq", F.col("rung").alias("l_rung"), F.col("confirmed").alias("l_confirmed"), F.coalesce("reason", F.lit("")).alias("reason"))).alias("l"))
    j = observed.select("url", "rung", "confirmed", F.lit(True).alias("seen")).join(entry.select("url", "n", "l.l_rung", "l.l_confirmed", "l.reason"), "url", "full")
    seen, known = F.col("seen").isNotNull(), F.col("n").isNotNull()
    found = F.array(
        F.when(~known, "unrecorded"), F.when(~seen, "recovered"), F.when(seen & known & (F.col("rung") != F.col("l_rung")), "misattributed"),
        F.when(seen & known & (F.col("confirmed") != F.col("l_confirmed")), "restanding"), F.when(known & (F.col("reason") == ""), "unargued"), F.when(F.col("n") > 1, "duplicated"))
    found = F.array_compact(found)
    return j.select("url", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("standing")))).alias("finding"))


def histogram_quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Quantile from buckets (le, n), n counted in each: linear within the bucket it falls in."""
    w = Window.partitionBy(*by).orderBy("le")
    c = buckets.select(*by, "le", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cum"), F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("lo"), "n", F.sum("n").over(Window.partitionBy(*by)).alias("all"))
    target = F.col("all") * q
    value = F.col("lo") + (F.col("le") - F.col("lo")) * (target - (F.col("cum") - F.col("n"))) / F.col("n")
    hit = c.filter((F.col("cum") >= target) & (F.col("cum") - F.col("n") < target))
    return hit.select(*by, F.round(value, 6).alias("quantile"))


def gate_findings(rows: DataFrame) -> DataFrame:
    """(url, finding) of rows (url, category, positive, outcome, accepted), outcome being reject,
    uncertain or certain_accept. A row may have several findings: a positive that is
    rejected leaks; a negative that is certainly accepted is a false certain, unless accepted
    as such; board roots must be certain and aggregators be rejected."""
    o, positive = F.col("outcome"), F.coalesce("positive", F.lit(False))
    false_certain = ~positive & (o == "certain_accept")
    accepted = F.coalesce("accepted", F.lit(False))
    want = F.when(F.col("category") == "hub_ats_root", "certain_accept").when(F.col("category") == "aggregator", "reject")
    found = F.array(
        F.when(positive & (o == "reject"), "leak"), F.when(false_certain & ~accepted, "false_certain"), F.when(false_certain & accepted, "accepted_false_certain"), F.when(o != want, "violation"))
    return rows.select("url", F.explode(F.array_compact(found)).alias("finding"))


def gate_scorecard(rows: DataFrame) -> DataFrame:
    """One row: total, llm_calls, llm_call_rate and the number of each finding."""
    kinds = ["leak", "false_certain", "accepted_false_certain", "violation"]
    counts = gate_findings(rows).agg(*[F.count_if(F.col("finding") == k).alias(k + "s") for k in kinds])
    total = rows.agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "uncertain").alias("llm_calls"))
    both = total.join(F.broadcast(counts))  # two single rows
    return both.select("total", "llm_calls", rate(F.col("llm_calls"), F.col("total")).alias("llm_call_rate"), *[k + "s" for k in kinds])


def extract_scorecard(rows: DataFrame) -> DataFrame:
    """One row of rows (url, label, extract): calls over all rows, the confusion over those whose
    label is not ambiguous, detail being positive."""
    label, called = F.col("label"), F.col("extract")
    scored, gold = label != "ambiguous", label == "detail"
    n = lambda c, name: F.count_if(c).alias(name)
    sums = rows.agg(
        F.count("*").alias("total"), n(called, "extract_calls"), n(~scored, "ambiguous"), n(~scored & called, "ambiguous_extracted"), n(label == "residue", "residue"), n((label == "residue") & called, "residue_extracted"),
        n(gold & called, "tp"), n(scored & ~gold & called, "fp"), n(gold & ~called, "fn"), n(scored & ~gold & ~called, "tn"))
    c = F.col
    out = sums.select("*", rate(c("extract_calls"), c("total")).alias("extract_call_rate"), rate(c("tp"), c("tp") + c("fp")).alias("precision"), rate(c("tp"), c("tp") + c("fn")).alias("recall"))
    return out.withColumn("f1", rate(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def free_scorecard(rows: DataFrame) -> DataFrame:
    """One row of rows (url, label, weight, free, accepted, expected): how much is read without a
    model, plainly and by weight; firings on what is no posting; expectations missing or unused."""
    free, detail = F.col("free"), F.col("label") == "detail"
    stray = free & ~detail
    forgiven = F.col("accepted") & (F.col("label") == "residue")
    weight = lambda c, name: F.sum(F.when(c, F.col("weight")).otherwise(0.0)).alias(name)
    n = lambda c, name: F.count_if(c).alias(name)
    s = rows.agg(
        F.count("*").alias("total"), n(free, "free"), n(detail, "details"), n(detail & free, "details_free"), n(stray & ~forgiven, "fired_on_non_posting"), n(stray & forgiven, "accepted_fires"),
        n(free & ~F.col("expected"), "missing_expectation"), n(~free & F.col("expected"), "unused_expectation"),
        weight(F.lit(True), "w"), weight(free, "w_free"), weight(detail, "w_detail"), weight(detail & free, "w_detail_free"))
    c = F.col
    return s.select(
        "total", "free", "details", "details_free", "fired_on_non_posting", "accepted_fires", "missing_expectation", "unused_expectation",
        rate(c("free"), c("total")).alias("free_rate"), rate(c("w_free"), c("w")).alias("stream_free_share"), rate(c("details_free"), c("details")).alias("coverage"), rate(c("w_detail_free"), c("w_detail")).alias("weighted_coverage"))


def expectation_lists(rows: DataFrame) -> DataFrame:
    """(url, finding) of rows (url, free, expected): what is read without a model and has no expectation (missing), and
    expectations of what is not (unused)."""
    free, expected = F.col("free"), F.col("expected")
    return rows.filter(free != expected).select("url", F.when(free, "missing").otherwise("unused").alias("finding"))


def panel(samples: DataFrame, seconds: int, by: list[str]) -> DataFrame:
    """(start, <by>, increase, rate, highest) of samples (ts, value, ..) by windows of time: what a counter grew by, that by
    second, and the highest sample."""
    w = F.window(F.col("ts").cast("timestamp"), f"{seconds} seconds")
    sums = samples.groupBy(w.alias("w"), *by).agg(F.sum("value").alias("increase"), F.max("value").alias("highest"))
    return sums.select(F.col("w.start").alias("start"), *by, F.round("increase", 4).alias("increase"), F.round(F.col("increase") / seconds, 6).alias("rate"), "highest")


def clamped_ratio(n: Column, d: Column, least: float = 1.0) -> Column:
    """n by d, d being taken for no less than so much."""
    return n / F.greatest(d.cast("double"), F.lit(least))


def field_divergences(want: DataFrame, got: DataFrame, fields: list[str]) -> DataFrame:
    """(url, field, want, got) where the two differ; both have url and the fields, as strings."""
    long = lambda d, name: d.unpivot("url", fields, "field", name)
    return long(want, "want").join(long(got, "got"), ["url", "field"]).filter(~F.col("want").eqNullSafe(F.col("got")))


def metric_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two reports (metric, value); metrics in neither are absent."""
    b, a = before.select("metric", F.col("value").alias("before")), after.select("metric", F.col("value").alias("after"))
    return b.join(a, "metric", "full").select("metric", "before", "after", F.round(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 4).alias("delta"))


def capture_timeline(captures: DataFrame) -> DataFrame:
    """(url, seq, verdict, timeline) of captures (url, ts, verdict, seq): the latest by ts as text, of
    equal ones the later, and all (ts, verdict) in order."""
    latest = F.max_by(F.struct("seq", "verdict"), F.struct("ts", "seq"))
    return captures.groupBy("url").agg(latest.alias("l"), F.sort_array(F.collect_list(F.struct("ts", "seq", "verdict"))).alias("timeline")).select("url", "l.seq", "l.verdict", "timeline")
