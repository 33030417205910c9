"""Queries of reviews, boundary reports and stage summaries, each with its SQL. Labels with their documents stand for gold rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.operators import evaluate, review
from jobloom.plans.registered import F1, SCORES, query, t

#: Documents as judged pages: the outcome by length, votes by three marks, the label by quality.
ROWS = """r AS (SELECT doc_id AS url, lang AS category, quality = 1 AS positive, toxic = 1 AS verified, CASE WHEN n_chars > 2500 THEN 'certain_accept' WHEN n_chars > 600 THEN 'uncertain' ELSE 'reject' END AS outcome,
  CASE WHEN source = 'src3' THEN [] WHEN source = 'src4' THEN [n_chars > 1500] ELSE [n_chars > 1200, lang <> 'fr', source <> 'src1'] END AS votes FROM labels JOIN documents USING (doc_id)),
v AS (SELECT *, len(votes) AS n_votes, len(list_filter(votes, lambda x: x)) AS yes FROM r),
w AS (SELECT *, n_votes > 0 AND 2 * yes >= n_votes AS vote, yes = 0 OR yes = n_votes AS unanimous FROM v),
p AS (SELECT *, CASE outcome WHEN 'certain_accept' THEN true WHEN 'uncertain' THEN vote ELSE false END AS predicted FROM w)"""


def _rows(spark, d):
    r = t(spark, d, "labels").join(t(spark, d, "documents").drop("text"), "doc_id")
    n, source = F.col("n_chars"), F.col("source")
    votes = F.when(source == "src3", F.array().cast("array<boolean>")).when(source == "src4", F.array(n > 1500)).otherwise(F.array(n > 1200, F.col("lang") != "fr", source != "src1"))
    outcome = F.when(n > 2500, "certain_accept").when(n > 600, "uncertain").otherwise("reject")
    return r.select(F.col("doc_id").alias("url"), F.col("lang").alias("category"), (F.col("quality") == 1).alias("positive"), (F.col("toxic") == 1).alias("verified"), outcome.alias("outcome"), votes.alias("votes"))


def _counts(want: str, got: str) -> str:
    return f"count(*) FILTER (WHERE {want} AND {got}) AS tp, count(*) FILTER (WHERE NOT {want} AND {got}) AS fp, count(*) FILTER (WHERE {want} AND NOT {got}) AS fn, count(*) FILTER (WHERE NOT {want} AND NOT {got}) AS tn"


@query(f"""WITH {ROWS}, c AS (SELECT {_counts('positive', 'vote')}, count(*) FILTER (WHERE NOT unanimous) AS flips, CASE WHEN count(*) = 0 THEN 0 ELSE round(count(*) FILTER (WHERE NOT unanimous) / count(*), 4) END AS flip_rate FROM p WHERE n_votes > 0),
s AS (SELECT {SCORES}, flips, flip_rate FROM c) SELECT *, {F1} FROM s""")
def vote_scorecard(spark, d):
    return review.vote_scorecard(_rows(spark, d))


@query(f"WITH {ROWS}, c AS (SELECT category, {_counts('positive', 'predicted')} FROM p GROUP BY 1), s AS (SELECT category, {SCORES} FROM c) SELECT *, {F1} FROM s")
def end_to_end_verdicts(spark, d):
    return review.end_to_end(_rows(spark, d), ["category"])


@query(f"""WITH {ROWS}, x AS (SELECT url, category, positive, CASE WHEN outcome <> 'uncertain' AND (outcome = 'certain_accept') <> positive THEN 'gate' END AS g,
  CASE WHEN (outcome <> 'uncertain' OR n_votes > 0) AND predicted <> positive THEN 'pipeline' END AS q FROM p WHERE NOT verified)
SELECT url, category, positive, concat_ws(',', g, q) AS reasons FROM x WHERE g IS NOT NULL OR q IS NOT NULL""")
def review_queue(spark, d):
    return review.review_queue(_rows(spark, d)).withColumn("reasons", F.array_join("reasons", ","))


LABELLED = "CASE WHEN lang = 'en' THEN 'detail' WHEN lang = 'de' THEN 'hub-index' WHEN source = 'src1' THEN 'ambiguous' ELSE 'residue' END"


def _labelled(spark, d):
    label = F.when(F.col("lang") == "en", "detail").when(F.col("lang") == "de", "hub-index").when(F.col("source") == "src1", "ambiguous").otherwise("residue")
    return t(spark, d, "documents").select(F.col("doc_id").alias("url"), label.alias("label"), "n_chars", "source", "lang")


@query(f"""WITH l AS (SELECT doc_id AS url, {LABELLED} AS label, n_chars > 900 AS extract, coalesce(source = 'src2', false) AS confirmed FROM documents)
SELECT count(*) AS rows, count(*) FILTER (WHERE extract) AS extracted, count(*) FILTER (WHERE NOT extract) AS skipped, count(*) FILTER (WHERE confirmed) AS confirmed, count(*) FILTER (WHERE NOT confirmed) AS unconfirmed,
  count(*) FILTER (WHERE NOT extract AND label = 'ambiguous') AS ambiguous_skipped, count(*) FILTER (WHERE NOT extract AND label = 'detail') AS false_drops,
  count(*) FILTER (WHERE label = 'detail') AS n_detail, count(*) FILTER (WHERE label = 'hub-index') AS n_hub_index, count(*) FILTER (WHERE label = 'residue') AS n_residue, count(*) FILTER (WHERE label = 'ambiguous') AS n_ambiguous FROM l""")
def boundary_scorecard(spark, d):
    r = _labelled(spark, d)
    return review.boundary_scorecard(r.select("url", "label", (F.col("n_chars") > 900).alias("extract"), F.coalesce(F.col("source") == "src2", F.lit(False)).alias("confirmed")))


@query("SELECT doc_id AS url, CASE WHEN n_chars > 1100 THEN 'reversed' WHEN lang = 'en' THEN 'accept' ELSE 'abstain' END AS side FROM documents WHERE (n_chars < 800 AND n_chars > 200) <> (n_chars > 1100)")
def boundary_disagreements(spark, d):
    n = F.col("n_chars")
    return review.boundary_disagreements(_labelled(spark, d).select("url", ((n < 800) & (n > 200)).alias("before"), (n > 1100).alias("after"), (F.col("lang") == "en").alias("verdict")))


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE length(html) > 4000)")
def uncommitted_urls(spark, d):
    p = t(spark, d, "pages")
    return review.excluding(p.select("page_id", "url"), p.filter(F.length("html") > 4000))


@query(f"""WITH l AS (SELECT {LABELLED} AS label, CASE WHEN n_chars > 500 THEN 'detail' ELSE '' END AS proposed_label, CASE WHEN n_chars < 3000 THEN 'me' END AS confirmed_by, CASE WHEN lang = 'en' THEN 1.5 ELSE 0.5 END AS weight FROM documents)
SELECT count(*) FILTER (WHERE proposed_label <> '' AND confirmed_by IS NOT NULL AND label IN ('detail', 'hub-index', 'residue') AND proposed_label = label) AS agreed,
  count(*) FILTER (WHERE proposed_label <> '' AND confirmed_by IS NOT NULL AND label IN ('detail', 'hub-index', 'residue')) AS comparable, CAST(sum(weight) AS DOUBLE) AS weight, abs(sum(weight) - count(*)) <= 0.000001 AS balanced FROM l""")
def label_agreement(spark, d):
    n = F.col("n_chars")
    r = _labelled(spark, d).select("label", F.when(n > 500, "detail").otherwise("").alias("proposed_label"), F.when(n < 3000, "me").alias("confirmed_by"), F.when(F.col("lang") == "en", 1.5).otherwise(0.5).alias("weight"))
    return review.label_agreement(r, ["detail", "hub-index", "residue"])


@query(r"""SELECT CASE WHEN n_chars > 2000 THEN 'structural' WHEN n_chars > 500 THEN 'flat' ELSE 'unstamped' END AS renderer, count(*) AS n, CAST(sum(len(regexp_extract_all(text, '[^\s\p{Z}]+'))) AS BIGINT) AS words FROM documents GROUP BY 1""")
def renderer_census(spark, d):
    n = F.col("n_chars")
    return review.renderer_census(t(spark, d, "documents").select(F.when(n > 2000, "structural").when(n > 500, "flat").otherwise("").alias("renderer"), F.col("text").alias("rendering")))


@query(f"""WITH l AS (SELECT {LABELLED} AS label, CAST(n_chars AS DOUBLE) AS w FROM documents), a AS (SELECT sum(w) AS s FROM l), k AS (SELECT unnest(['detail', 'hub-index', 'residue', 'none']) AS label)
SELECT k.label, count(l.label) AS n, round(coalesce(sum(w), 0) / any_value(s), 4) AS share FROM k CROSS JOIN a LEFT JOIN l ON l.label = k.label GROUP BY 1""")
def stream_composition(spark, d):
    return review.composition(_labelled(spark, d), "label", F.col("n_chars").cast("double"), ["detail", "hub-index", "residue", "none"])


@query(f"""WITH l AS (SELECT doc_id AS url, {LABELLED} AS label FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY url) - 1 AS i, count(*) OVER (PARTITION BY label) AS c FROM l),
k AS (SELECT DISTINCT label, CAST(floor(j * (c / 7.0)) AS BIGINT) AS i FROM r, (SELECT unnest(range(0, 7)) AS j))
SELECT url, r.label FROM r WHERE c <= 7 OR EXISTS (SELECT 1 FROM k WHERE k.label = r.label AND k.i = r.i)""")
def even_subsample(spark, d):
    return review.subsample(_labelled(spark, d).select("url", "label"), "label", "url", 7)


PCT = "CASE WHEN {1} = 0 THEN 0 ELSE round(100.0 * {0} / {1}, 1) END"


@query(f"""WITH l AS (SELECT doc_id AS url, {LABELLED} AS label, n_chars < 80 AS err, n_chars > 900 AS yes, source = 'src2' AS expd, lower(trim(lang)) AS title FROM documents),
s AS (SELECT count(*) FILTER (WHERE NOT err) AS scored, count(*) FILTER (WHERE err) AS errors, count(*) FILTER (WHERE NOT err AND label = 'detail') AS details, count(*) FILTER (WHERE NOT err AND yes AND label = 'detail') AS tp, count(*) FILTER (WHERE NOT err AND yes AND label <> 'detail') AS fp,
  count(*) FILTER (WHERE NOT err AND label = 'hub-index') AS hubs, count(*) FILTER (WHERE NOT err AND label = 'hub-index' AND NOT yes) AS hs, count(*) FILTER (WHERE NOT err AND label NOT IN ('detail', 'hub-index')) AS rs, count(*) FILTER (WHERE NOT err AND label NOT IN ('detail', 'hub-index') AND NOT yes) AS rn,
  count(*) FILTER (WHERE NOT err AND yes AND expd) AS compared, count(*) FILTER (WHERE NOT err AND yes AND expd AND title = 'en') AS ts, count(*) FILTER (WHERE NOT err AND yes AND expd) AS ls, count(*) FILTER (WHERE NOT err AND yes AND expd AND label = 'detail') AS ws FROM l),
q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE 100.0 * tp / (tp + fp) END AS p, CASE WHEN details = 0 THEN 0 ELSE 100.0 * tp / details END AS r FROM s)
SELECT scored, errors, tp, fp, {PCT.format('tp', 'details')} AS recall, {PCT.format('hs', 'hubs')} AS hub_shed, {PCT.format('rn', 'rs')} AS residue_shed, round(p, 1) AS precision, CASE WHEN p + r = 0 THEN 0 ELSE round(2 * p * r / (p + r), 1) END AS f1,
  {PCT.format('(tp + fp)', 'scored')} AS save_rate, compared, {PCT.format('ts', 'compared')} AS title_exact, {PCT.format('ls', 'compared')} AS location_exact, {PCT.format('ws', 'compared')} AS work_arrangement_exact FROM q""")
def extraction_report(spark, d):
    r = _labelled(spark, d)
    results = r.select("url", "label", F.when(F.col("n_chars") < 80, "timeout").alias("error"), (F.col("n_chars") > 900).alias("is_posting"), F.concat(F.lit(" "), "lang").alias("title"), F.lit("Wien  1").alias("location"), F.when(F.col("label") == "detail", "Remote").otherwise("").alias("work_arrangement"))
    expected = r.filter("source = 'src2'").select("url", F.lit("EN ").alias("title"), F.lit("wien 1").alias("location"), F.lit("remote").alias("work_arrangement"))
    return review.extraction_report(results, expected)


STAGES = ["call", "call", "error", "timeout", "gated", "seen", "dup", "retry", "deadletter", "abstain", "shadow_accept", "shadow_abstain"]


@query(f"""WITH e AS (SELECT event_type AS kind, {STAGES}[CAST(floor(value) AS INT) % 12 + 1] AS e FROM events),
s AS (SELECT kind, count(*) FILTER (WHERE e = 'call') AS calls, count(*) FILTER (WHERE e = 'error') AS errors, count(*) FILTER (WHERE e = 'timeout') AS timeouts, count(*) FILTER (WHERE e = 'gated') AS gated, count(*) FILTER (WHERE e = 'retry') AS retries, count(*) FILTER (WHERE e = 'deadletter') AS deadletters,
  count(*) FILTER (WHERE e = 'abstain') AS abstains, count(*) FILTER (WHERE e = 'seen') AS seen, count(*) FILTER (WHERE e = 'dup') AS dups, count(*) FILTER (WHERE e = 'shadow_accept') AS shadow_accepts, count(*) FILTER (WHERE e = 'shadow_abstain') AS shadow_abstains FROM e GROUP BY 1)
SELECT *, CASE WHEN gated + calls = 0 THEN 0 ELSE round(gated / (gated + calls), 4) END AS gate_hit_rate, CASE WHEN calls = 0 THEN 0 ELSE round(errors / calls, 4) END AS error_rate, CASE WHEN calls = 0 THEN 0 ELSE round(timeouts / calls, 4) END AS timeout_rate,
  CASE WHEN seen = 0 THEN 0 ELSE round(dups / seen, 4) END AS dup_ratio, CASE WHEN calls = 0 THEN 0 ELSE round(abstains / calls, 4) END AS empty_extraction_rate,
  CASE WHEN shadow_accepts + shadow_abstains = 0 THEN 0 ELSE round(shadow_accepts / (shadow_accepts + shadow_abstains), 4) END AS shadow_false_drop_rate FROM s""")
def stage_summary(spark, d):
    event = F.element_at(F.array(*map(F.lit, STAGES)), (F.floor("value").cast("int") % 12 + 1).cast("int"))
    return review.stage_summary(t(spark, d, "events").select(F.col("event_type").alias("kind"), event.alias("event")))


@query("""WITH e AS (SELECT event_type AS kind, ts, sha256(CAST(user_id AS VARCHAR)) AS h FROM events WHERE day(ts) NOT BETWEEN 8 AND 17),
g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY kind ORDER BY ts, h)) > 604800000000 THEN 1 ELSE 0 END AS gap FROM e),
p AS (SELECT *, sum(gap) OVER (PARTITION BY kind ORDER BY ts, h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM g),
f AS (SELECT kind, epoch, h, count(*) AS n FROM p GROUP BY ALL)
SELECT kind, CAST(sum(n) AS BIGINT) AS seen, CAST(sum(n - 1) AS BIGINT) AS dups, round(sum(n - 1) / sum(n), 4) AS dup_ratio FROM f GROUP BY 1""")
def repeated_contents(spark, d):
    e = t(spark, d, "events").filter(~F.dayofmonth("ts").between(8, 17))
    return review.repeated_contents(e.select(F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("string").alias("text")))


@query("""WITH o AS (SELECT doc_id AS url, lang AS rung, n_chars > 900 AS confirmed FROM documents WHERE lang <> 'de'),
l AS (SELECT doc_id AS url, CASE WHEN source = 'src5' THEN 'xx' ELSE lang END AS rung, n_chars > 1000 AS confirmed, CASE WHEN n_chars < 300 THEN '' ELSE 'why' END AS reason, 1 AS seq FROM documents WHERE lang <> 'fr'
  UNION ALL SELECT doc_id, lang, true, 'again', 2 FROM documents WHERE source = 'src1'),
g AS (SELECT url, count(*) AS n, arg_min(rung, seq) AS lr, arg_min(confirmed, seq) AS lc, arg_min(reason, seq) AS reason FROM l GROUP BY 1),
j AS (SELECT coalesce(o.url, g.url) AS url, o.url IS NOT NULL AS seen, n IS NOT NULL AS known, rung, lr, o.confirmed AS c, lc, reason, n FROM o FULL JOIN g ON o.url = g.url),
f AS (SELECT url, list_filter([CASE WHEN NOT known THEN 'unrecorded' END, CASE WHEN NOT seen THEN 'recovered' END, CASE WHEN seen AND known AND rung <> lr THEN 'misattributed' END, CASE WHEN seen AND known AND c <> lc THEN 'restanding' END,
  CASE WHEN known AND reason = '' THEN 'unargued' END, CASE WHEN n > 1 THEN 'duplicated' END], lambda x: x IS NOT NULL) AS fs FROM j)
SELECT url, unnest(CASE WHEN len(fs) = 0 THEN ['standing'] ELSE fs END) AS finding FROM f""")
def ledger_audit(spark, d):
    doc = t(spark, d, "documents").select(F.col("doc_id").alias("url"), F.col("lang").alias("rung"), "source", "n_chars")
    n = F.col("n_chars")
    first = doc.filter("rung <> 'fr'").select("url", F.when(F.col("source") == "src5", "xx").otherwise(F.col("rung")).alias("rung"), (n > 1000).alias("confirmed"), F.when(n < 300, "").otherwise("why").alias("reason"), F.lit(1).alias("seq"))
    again = doc.filter("source = 'src1'").select("url", "rung", F.lit(True).alias("confirmed"), F.lit("again").alias("reason"), F.lit(2).alias("seq"))
    return evaluate.ledger_audit(doc.filter("rung <> 'de'").select("url", "rung", (n > 900).alias("confirmed")), first.unionByName(again))


@query("SELECT doc_id AS url, CASE WHEN n_chars > 900 THEN 'missing' ELSE 'unused' END AS finding FROM documents WHERE (n_chars > 900) <> (lang = 'en')")
def expectation_lists(spark, d):
    r = _labelled(spark, d)
    return evaluate.expectation_lists(r.select("url", (F.col("n_chars") > 900).alias("free"), (F.col("lang") == "en").alias("expected")))


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, round(sum(value), 4) AS increase, round(sum(value) / 21600, 6) AS rate, max(value) AS highest FROM events GROUP BY 1, 2""")
def metric_panel(spark, d):
    return evaluate.panel(t(spark, d, "events"), 21_600, ["event_type"])


@query("""SELECT date_trunc('day', ts) AS day, round(count(*) FILTER (WHERE event_type = 'error') / greatest(count(*) FILTER (WHERE event_type = 'purchase'), 1), 4) AS errors_per_purchase FROM events GROUP BY 1""")
def clamped_ratios(spark, d):
    n = lambda k: F.count_if(F.col("event_type") == k)
    g = t(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(n("error").alias("e"), n("purchase").alias("p"))
    return g.select("day", F.round(evaluate.clamped_ratio(F.col("e"), F.col("p")), 4).alias("errors_per_purchase"))


@query("SELECT page_id, kind NOT IN (1, 2, 3, 4) AS accepted FROM (SELECT page_id, length(html) % 6 AS kind FROM pages)")
def valid_urls(spark, d):
    """URLs with a control character, a broken escape, a host with a space, a port that is no number; a broken escape in
    the query, and nothing wrong."""
    from jobloom.functions import urls

    kind = F.length("html") % 6
    bad = ["https://x.org/ok%20?a=%zz", "https://x.org/a\u0001b", "https://x.org/%zz", "https://x y.org/", "https://x.org:80a/", "https://[::1]:80/a b"]
    return t(spark, d, "pages").select("page_id", urls.parses(F.element_at(F.array(*map(F.lit, bad)), (kind + 1).cast("int"))).alias("accepted"))
