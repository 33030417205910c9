"""Shared helpers: tables cut from their lineage, size-checked broadcasts, words.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which
driver and executors share; so a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java pattern: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Only a local session may do without the
    setting; it then gets a temporary folder, as its driver is its executor."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="jobloom-"))
    return "file://" + _LOCAL_DIR[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cleanup(spark: SparkSession) -> None:
    """Delete every table this application has written with :func:`written`, and the
    temporary folder of a local session."""
    discard(spark, f"{shared_dir(spark)}/jobloom/{spark.sparkContext.applicationId}")
    while _LOCAL_DIR:
        shutil.rmtree(_LOCAL_DIR.pop(), ignore_errors=True)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcasting if it has at most ``max_rows`` rows, else as
    it is, to be shuffled. Call it on tables that are cheap to count."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: A key is hot from so many rows on, or from this share of the table on, so that there are at
#: most ``1 / HOT_SHARE`` hot keys, whatever the size.
HOT_ROWS = 1000
HOT_SHARE = 1e-4
MAX_SALTS = 4096


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], spread: list[str], how: str = "left", n_rows: int | None = None) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row a key, such that no key's rows land in
    one task: rows of a hot key are dealt over salts by the hash of the columns ``spread``, and
    that key's fact is copied for each salt. Only the hot keys and their counts are broadcast,
    10,000 at most. Null keys match nothing and are dealt by hash too. ``how`` is left or
    inner; ``rows`` is read twice, so it should be cheap to read. Who knows their number can say it."""
    n_rows = rows.count() if n_rows is None else n_rows
    if n_rows <= HOT_ROWS:  # no key can be hot
        return rows.join(facts, keys, how)
    most = max(HOT_ROWS, int(n_rows * HOT_SHARE))
    counts = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    hot = written(counts.select(*keys, F.least(F.ceil(F.col("_n") / most), F.lit(MAX_SALTS)).cast("int").alias("_salts")), "hot-keys")
    own = F.xxhash64(*[F.col(f"`{c}`") for c in spread])
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    if not hot.count():
        dealt = rows.withColumn("_salt", F.when(null, F.pmod(own, F.lit(MAX_SALTS))).otherwise(0).cast("int"))
        copies = facts.withColumn("_salt", F.lit(0))
    else:
        salts = F.when(null, F.lit(MAX_SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))
        dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(own, salts).cast("int")).drop("_salts")
        copies = facts.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_rows(docs: DataFrame, f) -> DataFrame:
    """``docs.mapInArrow`` to the same columns, which here may have dots in their names."""
    safe = [f"_column_{i}" if "." in c or "`" in c else c for i, c in enumerate(docs.columns)]
    rows = docs.toDF(*safe)
    return rows.mapInArrow(f, rows.schema).toDF(*docs.columns)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the library's own constants, made of literals within the plan."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    every = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(r, fields, strict=True)]) for r in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*every)))
