"""From raw documents to a training mix, in five stages, each written and read again.

Part of the subpackage ``jobloom.llm``. ``STAGES`` lists (name, function); each function takes
(spark, docs, sf_dir) and returns the documents that it leaves, with their columns, whatever
these are called. Every stage reads whole texts, leaves repeated rows alone unless it says
otherwise, and gives no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.llm import bloom, decontamination, mixing, pii, quality_model, simhash
from jobloom.llm.tables import small, table, written

MAX_BROADCAST_KEYS = 1_000_000  # of 16 bytes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on ``labels``, predicts as good. Null and
    empty texts are judged as texts without words; without labels, all are judged alike."""
    return quality_model.keep_good(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id. Rows that
    share a doc_id but not a text are each judged in the group of their text; of rows with the
    same doc_id and text one stays, the first by the hash of all columns. Rows without a doc_id
    stay, as no group is named after them.

    Decisions are made on identifiers and hashes. Most rows pass a Bloom filter of what goes
    where they are read; only the rest are joined.
    """
    gone, several = simhash.removed_keys(docs)
    named = lambda df, **as_: df.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text_hash"), *[F.lit(v).alias(k) for k, v in as_.items()])
    keys = written(named(gone, _stays=False).unionByName(named(several, _stays=True)), "removed-keys")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("_own"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text_hash"))
    h = F.xxhash64("_id", "_text_hash")
    marked = bloom.possible_hits(rows, h, keys.select(h.alias("h")))
    clear = marked.filter(~F.col("_possible") | F.col("_id").isNull())
    judged = marked.filter(F.col("_possible") & F.col("_id").isNotNull()).join(small(keys, MAX_BROADCAST_KEYS), ["_id", "_text_hash"], "left")
    alone = judged.filter("_stays IS NULL")
    first = Window.partitionBy("_id", "_text_hash").orderBy(F.xxhash64("_own"))
    repeated = judged.filter("_stays").withColumn("_place", F.row_number().over(first)).filter("_place = 1")
    left = clear.select("_own").unionAll(alone.select("_own")).unionAll(repeated.select("_own"))
    return left.select(*[F.col("_own").getField(c).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``. Null texts contain nothing; without
    items all stay."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in their texts; ``n_chars`` counts the new texts.
    Null texts stay null."""
    return pii.mask_personal_data(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with how many (mix_taken) and how often
    (mix_epochs). Texts without a word have none to take; null sources are one source."""
    return mixing.mixed_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mask_pii", mask_pii), ("mix", mix)]

#: The stages use models and fingerprints that SQL cannot express; tests hold them
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
