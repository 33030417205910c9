"""Mixing sources to target weights: hash-random keys, distributed prefix sums, exact cuts.

Sources share the total number of words by weight. No source gives more than
``MAX_EPOCHS`` times what it has; what it cannot give is shared again by weight among
the others until none is above. A source's budget is its target rounded down: as many
whole epochs as fit, then its documents in the order of their hash keys up to the exact
remaining word, so the last document may count in part.

Scale: word counts are taken once and written with the hash key as a narrow table. Keys
are uniform, so fixed ranges of the key split every source, however hot, into pieces of
like size; the prefix sums are first those of the pieces, summed by map-side combining,
then those within the one piece of each source that holds its cut. No window runs over a
source, and no text is shuffled.

Sources may be as many as domains: they are numbered by a range sort with an offset for each
range, and targets come from a few aggregations over one row per source. Each holds the sources
whose share is above their limit at the limit and shares out what is left, until none is above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.llm.tables import small, table, word_count, written

WEIGHTS = (1, 2, 3)  # of the sources by code point, null last, repeating
MAX_EPOCHS = 3
ROWS_PER_RANGE = 20_000
MAX_BROADCAST_SOURCES = 100_000


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the source as two columns without nulls, size, key."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("src_null"), word_count(F.col("text")).alias("size"), key.alias("key"))


def numbered(totals: DataFrame) -> DataFrame:
    """``totals`` with ``rank``, from 0, by code point of the source, null last."""
    ranged = written(totals.repartitionByRange("src_null", "src").withColumn("part", F.spark_partition_id()), "mix-sources")
    sizes = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())  # one row a partition
    before, offsets = 0, [0] * (sizes[-1][0] + 1 if sizes else 1)
    for part, n in sizes:
        offsets[part], before = before, before + n
    own = F.row_number().over(Window.partitionBy("part").orderBy("src_null", "src")) - 1
    return ranged.withColumn("rank", own + F.get(F.from_json(F.lit(str(offsets)), "array<bigint>"), F.col("part"))).drop("part")


def source_targets(totals: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Targets of sources (src, src_null, source_size), see the module's text."""
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * max_epochs
    rows = written(numbered(totals).select("src", "src_null", "source_size", w.alias("w"), limit.alias("limit")), "mix-shares")
    left, weight, held = rows.agg(F.sum("source_size"), F.sum("w"), F.lit(0)).first()
    total = left or 0
    share = lambda: F.lit(float(left or 0)) * F.col("w") / F.lit(weight or 1)
    while True:
        over = share() > F.col("limit")
        n, limits, free = rows.agg(F.count_if(over), F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("w")))).first()
        if n == held or free is None:
            break
        left, weight, held = total - (limits or 0), free, n
    return rows.select("src", "src_null", "source_size", F.when(share() > F.col("limit"), F.col("limit").cast("double")).otherwise(share()).alias("target"))


def mixing_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: src, src_null, source_size, target, epochs, rest, and the key
    group in which the last, partial epoch is cut (cut_key, cut_before, cut_size)."""
    ranges = max(1, -(-sizes.count() // ROWS_PER_RANGE))
    piece = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * ranges / float(1 << 32)).cast("int")
    sizes = sizes.withColumn("piece", piece)
    pieces = written(sizes.groupBy("src", "src_null", "piece").agg(F.sum("size").alias("words")), "mix-pieces")
    totals = pieces.groupBy("src", "src_null").agg(F.sum("words").alias("source_size"))
    budget = F.floor("target").cast("long")
    targets = source_targets(totals, weights, max_epochs).select(
        "*",
        F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0).alias("epochs"),
        F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(0).alias("rest"),
    )
    targets = written(targets, "mix-targets")
    source = ["src", "src_null"]
    by_piece = Window.partitionBy(*source).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        pieces.withColumn("piece_before", F.coalesce(F.sum("words").over(by_piece), F.lit(0)))
        .join(targets.select(*source, "rest"), source)
        .filter((F.col("piece_before") < F.col("rest")) & (F.col("rest") <= F.col("piece_before") + F.col("words")))
    )
    cut = small(written(cut.select(*source, "piece", "piece_before", "rest"), "mix-cuts"), MAX_BROADCAST_SOURCES)
    groups = sizes.join(cut, [*source, "piece"]).groupBy(*source, "key", "piece_before", "rest").agg(F.sum("size").alias("cut_size"))
    by_key = Window.partitionBy(*source).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("cut_before", F.col("piece_before") + F.coalesce(F.sum("cut_size").over(by_key), F.lit(0)))
    ends = groups.filter((F.col("cut_before") < F.col("rest")) & (F.col("rest") <= F.col("cut_before") + F.col("cut_size")))
    ends = ends.select(*source, F.col("key").alias("cut_key"), "cut_before", "cut_size")
    return written(targets.join(ends, source, "left"), "mix-plan")


def taken_words() -> Column:
    """Words that a row of size and key gives, by its source's plan. Rows with the same
    key share a cut in proportion to their sizes."""
    part = F.floor((F.col("rest") - F.col("cut_before")).cast("decimal(38,0)") * F.col("size") / F.col("cut_size")).cast("long")
    extra = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), part).otherwise(0)
    return (F.col("epochs") * F.col("size") + F.coalesce(extra, F.lit(0))).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, size, source_size, target, taken.

    Null texts have size 0 and take 0; null sources are one source, the last; null
    doc_ids share one key. Repeated rows each count and each give. A source without
    words has target 0. An empty table gives no rows. Other columns are ignored.
    """
    sizes = written(_keyed(docs), "mix-sizes")
    plan = small(mixing_plan(sizes, weights, max_epochs), MAX_BROADCAST_SOURCES)
    return sizes.join(plan, ["src", "src_null"]).select("doc_id", "size", "source_size", "target", taken_words().alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs`` of which the mix takes words, with all their columns, and
    ``mix_taken`` (words, repeats counted) and ``mix_epochs`` (taken by size). Columns of
    these names in ``docs`` are replaced. Texts stay where they are read."""
    plan = small(mixing_plan(written(_keyed(docs), "mix-sizes"), weights, max_epochs), MAX_BROADCAST_SOURCES)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.md5(F.coalesce(F.col("own.doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(own.alias("own")).select(
        "own", F.coalesce("own.source", F.lit("")).alias("src"), F.col("own.source").isNull().alias("src_null"), word_count(F.col("own.text")).alias("size"), key.alias("key"))
    rows = rows.join(plan, ["src", "src_null"]).withColumn("mix_taken", taken_words()).filter(F.col("mix_taken") > 0)
    keep = [c for c in docs.columns if c not in ("mix_taken", "mix_epochs")]
    return rows.select(*[F.col(f"own.`{c}`").alias(c) for c in keep], "mix_taken", (F.col("mix_taken") / F.col("size")).alias("mix_epochs"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: Over a table or view named by {docs}.
ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM {docs}),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
named AS (
  SELECT *, 3 * source_size AS lim, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS w
  FROM totals),
shares AS (
  SELECT *, lim / w AS ratio,
    CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER before, 0) AS BIGINT) AS lft,
    CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS BIGINT) AS wleft
  FROM named WINDOW before AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, CAST(lft AS DOUBLE) * w / wleft > lim AS held FROM shares),
free AS (SELECT lft AS flft, wleft AS fwleft FROM capped WHERE NOT held ORDER BY ratio, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size,
    CASE WHEN held THEN CAST(lim AS DOUBLE) ELSE CAST(flft AS DOUBLE) * w / fwleft END AS target
  FROM capped LEFT JOIN free ON true),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs,
    CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) % source_size ELSE 0 END AS rest
  FROM targets),
summed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, p.rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM summed
"""
