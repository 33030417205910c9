"""Streaming stages: deduplicated intake, keyed liveness, durable work with dead letters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobloom.functions import constants as K
from jobloom.functions.identity import hostname
from jobloom.functions.urls import frontier_url
from jobloom.operators import frontier


def frontier_urls(urls: DataFrame, max_depth: int = 3) -> DataFrame:
    """URLs of a table or stream (url, depth) within the depth, in their frontier form, with their host."""
    rows = urls.filter(F.col("depth") <= max_depth).withColumn("url", frontier_url(F.col("url")))
    return rows.withColumn("host", hostname(F.col("url")))


def start_intake(urls: DataFrame, folder: str, checkpoint: str, cap: int = K.VISITED_CAP, max_depth: int = 3) -> StreamingQuery:
    """A stream of URLs (url, depth, seq) into ``folder``: each batch's new URLs under ``admitted``, and what has been seen
    under ``seen``, the oldest of which is forgotten beyond the cap, so state stays bounded. A batch that is repeated
    after a failure overwrites its own results. Runs over what there is, then stops."""
    spark = urls.sparkSession
    empty = "url string, host string, seq long"

    def take(batch: DataFrame, i: int) -> None:
        seen = spark.createDataFrame([], empty).drop("host") if i == 0 else spark.read.schema("url string, seq long").parquet(f"{folder}/seen/{i - 1}")
        urls_ = batch.select("url", "host", "seq").persist()  # read three times below
        after, new = frontier.admit(seen, urls_, cap)
        new.write.mode("overwrite").parquet(f"{folder}/admitted/batch={i}")
        after.write.mode("overwrite").parquet(f"{folder}/seen/{i}")
        urls_.unpersist()

    rows = frontier_urls(urls, max_depth)
    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Of probes at one time, those that settle more come later.
_WEIGHT = {"inconclusive": 0, "dead": 1, "alive": 2}


def folded(state: tuple[bool, int], probes: pd.DataFrame, threshold: int) -> tuple[bool, int]:
    """(open, streak) after probes (at, outcome, complete): what the last one that resets says, and how many inconclusive
    ones came after its time. The same as folding a table of them."""
    rows = probes.assign(weight=probes["outcome"].map(_WEIGHT)).sort_values(["at", "weight"])
    resets = rows[(rows["outcome"] == "alive") | ((rows["outcome"] == "dead") & rows["complete"])]
    is_open, streak = state
    if len(resets):
        last = resets.iloc[-1]
        is_open, streak = bool(last["outcome"] == "alive"), 0
        rows = rows[rows["at"] > last["at"]]
    streak += int((rows["outcome"] == "inconclusive").sum())
    return is_open and not 0 < threshold <= streak, streak


def liveness_stream(probes: DataFrame, threshold: int = K.LIVENESS_THRESHOLD) -> DataFrame:
    """State (key, open, streak) after each batch of a stream of probes (key, at, outcome, complete)."""

    def fold(key, frames, state):
        after = folded(state.get if state.exists else (True, 0), pd.concat(list(frames)), threshold)
        state.update(after)
        yield pd.DataFrame({"key": [key[0]], "open": [after[0]], "streak": [after[1]]})

    return probes.groupBy("key").applyInPandasWithState(fold, "key long, open boolean, streak long", "open boolean, streak long", "update", "NoTimeout")


def shadow_sample(rejects: DataFrame, rate: float = 0.01) -> DataFrame:
    """A share of the rejects by a hash of their URL, the same on every run."""
    return rejects.filter(F.pmod(F.xxhash64("url"), F.lit(10_000)) < int(rate * 10_000))


def retry_or_bury(failed: DataFrame, max_attempts: int) -> tuple[DataFrame, DataFrame]:
    """Failed work (.., attempts) to try again with one attempt more, and that which is given up."""
    tried = failed.withColumn("attempts", F.col("attempts") + 1)
    return tried.filter(F.col("attempts") < max_attempts), tried.filter(F.col("attempts") >= max_attempts)
