"""Connected components of links between 64-bit keys, by contraction.

Each round points every node to its least neighbour and replaces nodes by what they
point to. The order is that of a hash, so that a chain of links shrinks by a constant
factor in each round, whatever its direction. A node at the centre of many links is
handled by map-side minima, and by joins that deal its links over salts
(:func:`jobloom.llm.tables.hot_join`), never by gathering its neighbours. Each round is
written, so a lost executor costs no more than the tasks it ran; tables that are no longer
needed are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.tables import discard, fresh_path, hot_join

#: With so many links left or fewer, one bounded task joins up what remains.
LAST_LINKS = 50_000


def _save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _join_up(batches):
    """(node, root) of all links of the one, bounded input."""
    import pyarrow as pa

    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p] = up.setdefault(p, p)
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(links: DataFrame, last_links: int = LAST_LINKS) -> DataFrame:
    """(node, root) for each node of ``links`` (a long, b long): two nodes have the same
    root exactly if they are connected. Self-links and repeated links do no harm;
    without links there are no rows."""
    spark = links.sparkSession
    edges, path = _save(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps: list[tuple[DataFrame, str]] = []
    while edges.count() > last_links:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        to = both.groupBy("a").agg(F.min(rank("b")).alias("least")).select(F.col("a").alias("node"), F.least(rank("a"), "least")["v"].alias("to"))
        steps.append(_save(to, "pointers"))
        to = steps[-1][0]
        left, half = _save(hot_join(edges, to.select(F.col("node").alias("a"), F.col("to").alias("a_to")), ["a"], ["b"], "inner"), "half-moved")
        left = hot_join(left, to.select(F.col("node").alias("b"), F.col("to").alias("b_to")), ["b"], ["a"], "inner")
        left = left.filter("a_to != b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        was = path
        edges, path = _save(left, "links")
        discard(spark, was)
        discard(spark, half)
    roots, at = _save(edges.coalesce(1).mapInArrow(_join_up, "node long, root long"), "roots")
    discard(spark, path)
    for to, pointers in reversed(steps):
        # Nodes that still had links have a root; the others point to it, or are it.
        found = hot_join(to, roots.select(F.col("node").alias("to"), "root"), ["to"], ["node"]).select("node", F.coalesce("root", "to").alias("root"))
        was = at
        roots, at = _save(found, "roots")
        discard(spark, was)
        discard(spark, pointers)
    return roots
