"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed URL is a host and a path prefix; it covers its host, all subdomains, and all
paths that start with its path. Each page's URL is canonicalised to (host, path) and
expanded, within its row, to the keys under which a listed URL could cover it: host suffixes
(as many labels as the longest listed host has) times path prefixes (the lengths that
occur in the list). The keys probe the filter in the row; only those that may be listed become
rows and go on to a hash join with the list, which removes the false positives. The longest listed
key wins.

Scale: only the URL column is read. The filter is an array of 256-bit blocks whose number
has a fixed upper bound, so it goes out with the plan; a fuller filter lets more keys through to
the exact join but never changes a result. The list itself is broadcast only up to a checked
row count; beyond it the join is shuffled, with the rows of hot keys dealt over salts, since one
listed key (a top-level domain) may cover a third of the pages. One further shuffle brings
together what map-side aggregation has already reduced to one row per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import bloom
from jobloom.llm.tables import ascii_lower, hot_join, literal_table, table, written

#: The listed canonical URLs of the registered query: host, path prefix, action.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

MAX_BROADCAST_RULES = 50_000


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://``.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
    Path: from there up to ``?``, ``#`` or the end.
    """
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge each row of ``pages`` (page_id, url) by ``rules`` (host, path, action).

    Returns page_id, host, path, rule, verdict; one row for each row of pages.
    Null or unparsable URLs: empty host and path, covered by no rule, ``default``.
    Rows may repeat and page_id may be null; each row is judged. Rules with null host
    or path count as empty there; of equal rules with several actions the
    last in code-point order (block before allow) holds. No rules: all get ``default``.
    Other columns of either table are ignored, whatever their names.
    """
    rules = (
        rules.select(F.coalesce("host", F.lit("")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "action")
        .filter("rule_path = '' OR rule_path LIKE '/%'")  # a path that is not empty starts so
        .groupBy("rule_host", "rule_path")
        .agg(F.max("action").alias("action"))
        .withColumn("key", F.concat("rule_host", "rule_path"))
    )
    shape = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    host, path = canonical(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    if not shape["n"]:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = bloom.blocks_for(shape["n"])
    words = bloom.as_literal(bloom.filled_blocks(rules.select(F.xxhash64("key").alias("h")), blocks), blocks)
    lengths = F.array(*[F.lit(x) for x in sorted(shape["lengths"])])
    labels = F.col("labels")
    suffix = lambda i: F.array_join(F.slice(labels, -i, i), ".")
    keys = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape["labels"]))),
            lambda i: F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.concat(suffix(i), F.substring(F.col("path"), F.lit(1), n))),
        )
    )
    hits = F.filter(keys, lambda k: bloom.may_hold(words, F.xxhash64(k), blocks))
    # The null key stands for the page itself, so that pages without a hit stay.
    keyed = urls.withColumn("labels", F.split("host", r"\.")).select("page_id", "host", "path", hits.alias("hits"))
    possible = keyed.select("page_id", "host", "path", F.explode(F.concat(F.array(F.lit(None).cast("string")), "hits")).alias("key"))
    listed = rules.select("key", "action")
    if shape["n"] <= MAX_BROADCAST_RULES:
        exact = possible.join(F.broadcast(listed), "key", "left")
    else:
        exact = hot_join(written(possible, "possible-urls"), listed, ["key"], ["page_id", "host", "path"])
    best = F.max(F.when(F.col("action").isNotNull(), F.struct(F.length("key").alias("n"), "key", "action")))
    judged = exact.groupBy("page_id", "host", "path").agg(best.alias("best"), F.count_if(F.col("key").isNull()).alias("copies"))
    return judged.select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literal_table(spark, RULES, "host string, path string, action string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


ORACLE = """
WITH rules(rhost, rpath, action) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (
  SELECT row_number() OVER () AS rid, page_id,
    CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS r
  FROM pages),
parsed AS (
  SELECT rid, page_id,
    translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
fits AS (
  SELECT rid, rhost || rpath AS rule, action,
    row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, rhost || rpath DESC) AS k
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parsed LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (rid)
"""
