"""Bounded, deterministic samples of labelled rows, for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.tables import small

MAX_BROADCAST_LABELS = 100_000


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the doc_id as text leaves this rest; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


def per_class_sample(rows: DataFrame, label: str, id_column: str, text: str, per_class: int) -> DataFrame:
    """(label, id, text) of the ``per_class`` different rows of each label that come first by the
    hash of id and text. Rows that repeat count once, so no repeated id or text can fill
    a sample or keep others out of it; of a label with fewer rows all are taken.

    The different rows of a label are counted by a sketch first. A hash threshold then leaves
    a few times what is wanted of each label, however large, before anything is
    shuffled or ranked.
    """
    keyed = rows.select(F.col(label).alias("label"), F.col(id_column).alias("id"), F.col(text).alias("text"))
    h = F.xxhash64("id", F.col("id").isNull(), "text")
    counts = keyed.groupBy("label").agg(F.approx_count_distinct(h, 0.05).alias("n"))
    # At 5 % deviation, so many are left of each label that fewer than per_class are out of the question.
    share = F.lit(float(3 * per_class + 60)) / F.col("n")
    few = keyed.join(small(counts, MAX_BROADCAST_LABELS), "label").withColumn("h", h).filter(F.pmod("h", F.lit(1 << 40)) < share * float(1 << 40))
    few = few.groupBy("label", "id", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("label").orderBy("h", "id")
    few = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_class)
    return few.select(F.col("label").alias(label), F.col("id").alias(id_column), F.col("text").alias(text))
