"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

1. Fingerprints. One pass over the texts; XXH64 of word shingles, bit majorities in
   numpy. Written with the doc_id as 16 bytes a row; texts are not moved.
2. Equal fingerprints become one node with the smallest doc_id, by map-side minima; so
   exact copies, however many, are one row from here on.
3. Blocks. With ``k`` blocks and at most ``d`` differing bits, ``k - d`` blocks of a close
   pair are equal; each node is dealt to all choices of ``k - d`` blocks. ``k`` follows
   the number of nodes, so that the bits of a choice keep chance company rare.
4. Small buckets are joined with themselves on the choice and verified by bit count in the
   join. A large bucket is cut into cells of a bounded number of nodes; each pair of
   cells is compared in numpy and returns a spanning forest of its links, not all pairs.
   No candidate is dropped. The largest buckets are few by arithmetic, are told to all tasks, and
   go to their cells without ever being dealt by bucket.
5. Links are joined up by contraction (:mod:`jobloom.llm.components`). Large components and
   fingerprints of very many rows are dealt over salts when names are joined back.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.components import components
from jobloom.llm.tables import HOT_SHARE, hot_join, table, written

WORDS_PER_SHINGLE = 4
MAX_DISTANCE = 4
SEED = 42
SMALL_BUCKET = 64  # nodes; up to here the join compares all
CELL = 4096  # nodes of a large bucket compared in one task, twice


def fingerprint(text: str | None, k: int = WORDS_PER_SHINGLE) -> int:
    """64 bits; a bit is 1 if it is set in over half the shingles' hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest as xxh

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) <= k:
        return xxh(b" ".join(words), SEED)
    ones, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = words[at : at + (1 << 16) + k - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        hashes = np.array([xxh(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], dtype=np.uint64)  # noqa: B905
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(found.view(np.int64))], names=[*kept, "fp"])


def fingerprints(docs: DataFrame, with_hash: bool = False) -> DataFrame:
    """(doc_id, fp) of each row of ``docs``, with text_hash between them if asked for; null and
    empty texts have fp 0."""
    extra = [F.xxhash64("text").alias("text_hash")] if with_hash else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long" if with_hash else "doc_id long, fp long")


def block_count(nodes: int, distance: int) -> int:
    """Blocks such that a choice has at least as many bits as it takes to number the nodes."""
    k = distance + 1
    while 64 * (k - distance) // k < max(1, nodes).bit_length() and k < 2 * distance:
        k += 1
    return k


def choices(k: int, distance: int) -> list[int]:
    """The masks of all choices of ``k - distance`` of ``k`` blocks of the 64 bits."""
    edges = [64 * i // k for i in range(k + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, k - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linker(distance: int):
    def link(key, table):
        """A spanning forest of the close pairs among the nodes of one pair of cells."""
        import numpy as np
        import pyarrow as pa

        fps = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        up = np.arange(len(fps))
        pairs = []

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for at in range(0, len(fps), 256):
            rows = fps[at : at + 256]
            near = np.bitwise_count(rows[:, None] ^ fps[None, at:]) <= distance
            i, j = np.nonzero(near)
            i, j = i + at, j + at
            keep = i < j
            i, j = i[keep], j[keep]
            # Links within one tree say nothing new, and one link of two trees is enough.
            tops = up
            while (tops[tops] != tops).any():
                tops = tops[tops]
            up = tops.copy()
            a, b = np.minimum(tops[i], tops[j]), np.maximum(tops[i], tops[j])
            _, first = np.unique(a * len(fps) + b, return_index=True)
            for n in first[(a != b)[first]].tolist():
                x, y = root(int(i[n])), root(int(j[n]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    pairs.append((int(i[n]), int(j[n])))
        ij = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        signed = fps.view(np.int64)
        return pa.table({"a": pa.array(signed[ij[:, 0]]), "b": pa.array(signed[ij[:, 1]])})

    return link


def near_links(nodes: DataFrame, distance: int = MAX_DISTANCE, small_bucket: int = SMALL_BUCKET, cell: int = CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``nodes.fp`` that join up exactly those
    within ``distance`` bits of each other."""
    n_nodes = nodes.count()
    masks = choices(block_count(n_nodes, distance), distance)
    every = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)])
    dealt = nodes.select("fp", F.explode(every).alias("c")).select("fp", F.col("c.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("c.mask")).alias("bits"))
    bucket = ["choice", "bits"]
    counts = written(dealt.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1"), "buckets")  # those alone in a bucket are gone
    most = max(cell, int(HOT_SHARE * n_nodes * len(masks)))
    large = F.broadcast(counts.filter(F.col("n") > most))  # at most 1 / HOT_SHARE rows
    company = dealt.join(large.select(*bucket), bucket, "left_anti").join(counts.filter(F.col("n") <= most), bucket).unionByName(dealt.join(large, bucket))
    company = written(company, "blocks")
    few = company.filter(F.col("n") <= small_bucket).drop("n")
    other = few.select("choice", "bits", F.col("fp").alias("other"))
    close = (F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance)
    links = few.join(other, ["choice", "bits"]).filter(close).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    many = company.filter(F.col("n") > small_bucket).withColumn("cells", F.ceil(F.col("n") / cell).cast("int"))
    many = many.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int"))
    many = many.select("fp", "choice", "bits", "mine", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("yours"))
    cells = many.select("fp", "choice", "bits", F.least("mine", "yours").alias("x"), F.greatest("mine", "yours").alias("y"))
    dense = cells.groupBy("choice", "bits", "x", "y").applyInArrow(_linker(distance), "a long, b long")
    return links.unionByName(dense)


def grouped(prints: DataFrame, first: Column, distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, root, first) of each different fingerprint of ``prints.fp``: equal roots are one
    group; ``first`` is an aggregate over the rows of the fingerprint."""
    nodes = written(prints.groupBy("fp").agg(first.alias("first")), "nodes")
    roots = components(near_links(nodes, distance))
    rooted = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return written(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")


def removed_keys(docs: DataFrame, distance: int = MAX_DISTANCE) -> tuple[DataFrame, DataFrame]:
    """What goes if one row of each group of near-duplicates stays, by keys (doc_id, text_hash),
    where text_hash is xxhash64 of the text: first the keys of which no row stays, then the keys
    of which one of several rows does.

    The row that stays has the smallest doc_id of its group, then the smallest text_hash. Rows are
    judged by doc_id *and* text: rows that share a doc_id but not a text are in the groups of their
    texts. Rows without a doc_id belong to no group.
    """
    prints = written(fingerprints(docs.filter("doc_id IS NOT NULL"), with_hash=True), "fingerprints")
    winners = grouped(prints, F.min(F.struct("doc_id", "text_hash")), distance).groupBy("root").agg(F.min("first").alias("first"))
    winners = winners.select("first.doc_id", "first.text_hash", F.lit(True).alias("wins"))
    keys = prints.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).join(winners, ["doc_id", "text_hash"], "left")
    keys = written(keys, "judged-keys")
    return keys.filter("wins IS NULL").select("doc_id", "text_hash"), keys.filter("wins AND n > 1").select("doc_id", "text_hash")


def near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    component_id is the smallest doc_id that is reachable over fingerprints with at
    most ``distance`` differing bits, itself included. Null and empty texts have
    fingerprint zero and link like any other. Repeated rows each get a row; a null doc_id
    is linked but never the smallest, unless its component has no other (then null). An
    empty table gives no rows; other columns are ignored.
    """
    prints = written(fingerprints(docs), "fingerprints")
    rooted = grouped(prints, F.min("doc_id"), distance)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = hot_join(rooted.select("fp", "root"), least, ["root"], ["fp"], "inner").select("fp", "component_id")
    return hot_join(prints, named, ["fp"], ["doc_id"], "inner").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
