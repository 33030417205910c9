"""The crawl frontier as snapshots: what has been seen, queues by host, cooldowns and leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import constants as K


#: So many rows or fewer are put in order to find a cut among them.
EDGE_ROWS = 10_000


def newest(rows: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` rows of ``rows`` (url, seq) that are newest by seq, then url; all if there are no more.

    Where the cut falls is found by counting ranges of seq, narrowing down on the one that holds it; only the rows
    of that last, short range are put in order. So no task sees more than its share."""
    drop = rows.count() - cap
    if drop <= 0:
        return rows
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    while True:
        width = -(-(high - low + 1) // 1000)
        inside = rows.filter(F.col("seq").between(low, high))
        counts = sorted((r["range"], r["count"]) for r in inside.groupBy(F.floor((F.col("seq") - low) / width).alias("range")).count().collect())  # at most 1000
        for k, n in counts:
            if drop < n:
                break
            drop -= n
        low, high = low + k * width, min(high, low + (k + 1) * width - 1)
        if n <= EDGE_ROWS or low == high:
            break
    if not drop:
        return rows.filter(F.col("seq") >= low)
    edge = rows.filter(F.col("seq").between(low, high)).select("seq", "url").orderBy("seq", "url").limit(drop)
    last = edge.agg(F.max(F.struct("seq", "url")).alias("last")).first()["last"]
    return rows.filter((F.col("seq") > last["seq"]) | ((F.col("seq") == last["seq"]) & (F.col("url") > last["url"])))


def admit(seen: DataFrame, urls: DataFrame, cap: int = K.VISITED_CAP) -> tuple[DataFrame, DataFrame]:
    """(new seen, admitted) for ``urls`` (url, host, seq) against ``seen`` (url, seq): each URL once, the
    first by seq; one seen again keeps its place. Beyond the cap the oldest are forgotten; a cap
    that is not positive forgets nothing."""
    first = urls.groupBy("url").agg(F.min(F.struct("seq", "host")).alias("f")).select("url", "f.host", "f.seq")
    admitted = first.join(seen.select("url"), "url", "left_anti")
    every = seen.select("url", "seq").unionByName(admitted.select("url", "seq"))
    return (newest(every, cap) if cap > 0 else every), admitted


def mark_visited(seen: DataFrame, urls: DataFrame, cap: int = K.VISITED_CAP) -> DataFrame:
    """``seen`` (url, seq) with ``urls`` (url, seq) that are not to be visited, nothing of which is queued."""
    return admit(seen, urls.withColumn("host", F.lit("")), cap)[0]


def mark_done(leases: DataFrame, done: DataFrame) -> DataFrame:
    """Leases without those of ``done`` (url)."""
    return leases.join(done.select("url"), "url", "left_anti").select(leases.columns)


def delete_run(tables: list[DataFrame], run: str) -> list[DataFrame]:
    """The frontier's tables (run, ..) without anything of one run."""
    return [d.filter(F.col("run") != run) for d in tables]


def length(queue: DataFrame, leases: DataFrame) -> DataFrame:
    """(host, length): what is queued or leased."""
    return queue.select("host").unionByName(leases.select("host")).groupBy("host").agg(F.count("*").alias("length"))


def ends(verdict: Column, perpetual: bool) -> Column:
    """Whether a walk is over: a bounded one when nothing is queued or leased, a perpetual one never."""
    return F.lit(not perpetual) & (verdict == "done")


def start_cycle(runs: DataFrame, definition: str, run_id: str, now: Column, interval_seconds: int) -> DataFrame:
    """Runs (run_id, definition, status, started_at) with a new one of the definition if it is due. One tick of the
    scheduler, which a caller repeats at the start and every minute."""
    mine = runs.filter(F.col("definition") == definition)
    active = F.count_if(F.col("status").isin("running", "stopping", "pausing", "paused")) > 0
    start = mine.agg(active.alias("active"), F.max("started_at").alias("last")).filter(due(now, F.col("last"), F.col("active"), interval_seconds))
    return runs.select("run_id", "definition", "status", "started_at").unionByName(start.select(F.lit(run_id).alias("run_id"), F.lit(definition).alias("definition"), F.lit("running").alias("status"), now.alias("started_at")))


def reclaim(queue: DataFrame, leases: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(queue, leases) after leases (url, host, seq, expires) that have run out go back into the queue."""
    out = F.col("expires") <= now
    return queue.unionByName(leases.filter(out).select(queue.columns)), leases.filter(~out)


def pop(queue: DataFrame, hosts: DataFrame, now: Column, n: int, cooldown: int = K.COOLDOWN_SECONDS, lease: int = K.LEASE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(leased, hosts): a round of up to n pops at one time, one URL of each host that may be asked.

    ``queue`` has url, host, seq; ``hosts`` host, next_eligible (absent: at once). Hosts that have
    waited longest come first, ties by name; the first URL of each by seq is taken by a partial
    aggregation. A host asked waits for its cooldown."""
    heads = queue.groupBy("host").agg(F.min(F.struct("seq", "url")).alias("head"))
    able = heads.join(hosts, "host", "left").filter(F.col("next_eligible").isNull() | (F.col("next_eligible") <= now))
    taken = able.orderBy(F.asc_nulls_first("next_eligible"), "host").limit(n)
    leased = taken.select("head.url", "host", "head.seq", (now + F.make_dt_interval(secs=F.lit(lease))).alias("expires"))
    asked = leased.select("host", (now + F.make_dt_interval(secs=F.lit(cooldown))).alias("next_eligible"))
    return leased, hosts.join(asked, "host", "left_anti").unionByName(asked)


def status(queue: DataFrame, leases: DataFrame, hosts: DataFrame, now: Column) -> DataFrame:
    """One row: queued, leased, verdict (url if some host may be asked, wait, done), wake (when the
    next host may be)."""
    waiting = queue.select("host").distinct().join(hosts, "host", "left").agg(
        F.count_if(F.col("next_eligible").isNull() | (F.col("next_eligible") <= now)).alias("able"), F.min("next_eligible").alias("next"))
    counts = queue.agg(F.count("*").alias("queued")).join(F.broadcast(leases.agg(F.count("*").alias("leased")))).join(F.broadcast(waiting))  # single rows
    verdict = F.when(F.col("able") > 0, "url").when(F.col("queued") + F.col("leased") > 0, "wait").otherwise("done")
    return counts.select("queued", "leased", verdict.alias("verdict"), F.when(verdict == "wait", F.col("next")).alias("wake"))


def due(now: Column, last: Column, active: Column, interval_seconds: int) -> Column:
    """Whether a cycle is to start: not while one runs, at once if none ever did, else after the interval."""
    return F.when(active, False).when(last.isNull(), True).otherwise(now >= last + F.make_dt_interval(secs=F.lit(interval_seconds)))
