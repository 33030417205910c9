"""Blocked Bloom filters of 64-bit hashes: tables of 256-bit blocks, of bounded number.

A key sets one bit in each of the four words of its one block. A filter fuller than meant lets
more keys through; callers follow up with an exact join, so it never changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 4  # of 64 bits in a block
MAX_BLOCKS = 1 << 16  # 2 MB of bits: the bound of what is sent out
KEYS_PER_BLOCK = 20  # about 13 bits a key


def blocks_for(keys: int) -> int:
    return min(MAX_BLOCKS, 1 << max(0, (keys // KEYS_PER_BLOCK).bit_length()))


def block_of(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def masks(h: Column) -> list[Column]:
    """One bit for each word of the block, from a second hash."""
    again = F.xxhash64(h, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(again, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def filled_blocks(hashes: DataFrame, blocks: int) -> DataFrame:
    """The non-empty blocks of a filter of ``hashes.h``: (block, w0..w3), at most ``blocks`` rows."""
    rows = hashes.select(block_of(F.col("h"), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(masks(F.col("h")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def as_literal(filled: DataFrame, blocks: int) -> Column:
    """All words of a filter as one literal array, to be probed within a row."""
    words = [0] * (blocks * WORDS)
    for r in filled.collect():  # at most MAX_BLOCKS rows
        words[r["block"] * WORDS : (r["block"] + 1) * WORDS] = [r[f"w{i}"] for i in range(WORDS)]
    return F.from_json(F.lit(str(words)), "array<bigint>")


def may_hold(words: Column, h: Column, blocks: int) -> Column:
    """Whether the filter may hold a hash; true for all that it does hold."""
    at = block_of(h, blocks) * WORDS
    hit = F.lit(True)
    for i, m in enumerate(masks(h)):
        hit = hit & (F.get(words, at + i).bitwiseAND(m) != 0)
    return hit


def possible_hits(rows: DataFrame, h: Column, keys: DataFrame) -> DataFrame:
    """``rows`` with a column ``_possible``: whether the hash ``h`` may be one of ``keys.h``."""
    blocks = blocks_for(keys.count())
    filled = F.broadcast(filled_blocks(keys, blocks))  # at most MAX_BLOCKS rows
    hit = F.lit(True)
    for i, m in enumerate(masks(F.col("_h"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) != 0)
    found = rows.withColumn("_h", h).withColumn("block_", block_of(F.col("_h"), blocks)).join(filled.withColumnRenamed("block", "block_"), "block_", "left")
    return found.withColumn("_possible", F.coalesce(hit, F.lit(False))).drop("_h", "block_", *[f"w{i}" for i in range(WORDS)])
