"""Captured decisions and gold sets as files: one JSON object a line, and sheets of tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.operators.evaluate import capture_timeline

#: Fixed values. Longest line that is read, in bytes; captures kept of each verdict.
MAX_LINE_BYTES, MAX_PER_VERDICT = 512 * 1024, 2000
CONTENT = "STRUCT<Title:STRING,MainContent:STRING,URLs:ARRAY<STRING>,JSONLD:ARRAY<STRING>,SiteName:STRING,Embeds:ARRAY<STRUCT<Src:STRING,IsFrame:BOOLEAN>>,ElementIDs:ARRAY<STRING>>"
CAPTURE = f"url STRING, verdict BOOLEAN, ts STRING, renderer STRING, content {CONTENT}"
PROVENANCE = "STRUCT<proposed_by:STRING,proposed_at:STRING,proposed_label:STRING,confirmed_by:STRING,confirmed_at:STRING,note:STRING>"
EXPECTED = "STRUCT<title:STRING,location:STRING,work_arrangement:STRING,free_ok:BOOLEAN,free_ok_note:STRING,proposed_by:STRING,proposed_at:STRING,confirmed_by:STRING,confirmed_at:STRING>"
GOLD = f"url STRING, verdict BOOLEAN, ts STRING, renderer STRING, label STRING, stratum STRING, weight DOUBLE, label_provenance {PROVENANCE}, expected {EXPECTED}, content {CONTENT}"
#: Fixed values. Columns of a sheet of labels and of one of expected fields.
LABEL_SHEET = "id url label stratum verdict note proposed_by confirmed_by title".split()
EXPECTED_SHEET = "id url label title location work_arrangement free_ok free_ok_note proposed_by confirmed_by".split()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, raw) of a text file; the numbers grow with the file but need not be dense."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.col("value").alias("raw"))


def scan_captures(lines: DataFrame) -> DataFrame:
    """(url, seq, verdict, timeline) of lines (line, raw): of each URL the latest capture by its time as text, of equal ones the
    later line, and all its (time, line, verdict). Lines that are too long, broken, or of no http URL are left out."""
    rows = lines.filter(F.octet_length("raw") <= MAX_LINE_BYTES).select("line", F.from_json("raw", CAPTURE).alias("c")).select("line", "c.url", "c.verdict", "c.ts")
    good = rows.filter(F.col("url").rlike("^https?://[^/?#\\s]+") & F.col("verdict").isNotNull())
    return capture_timeline(good.select("url", "ts", "verdict", F.col("line").alias("seq")))


def capped(captures: DataFrame, order: str, cap: int = MAX_PER_VERDICT) -> DataFrame:
    """The first captures of each verdict, as many as a capture file takes. They need the name of a renderer."""
    named = captures.filter(F.coalesce("renderer", F.lit("")) != "")
    w = Window.partitionBy("verdict").orderBy(order)
    return named.withColumn("rn_", F.row_number().over(w)).filter(F.col("rn_") <= cap).drop("rn_")


def write_captures(captures: DataFrame, order: str, path: str, cap: int = MAX_PER_VERDICT) -> None:
    """Append captures (the columns of ``CAPTURE``) to the file set under ``path``."""
    capped(captures, order, cap).select(*[c.split(" ")[0] for c in CAPTURE.split(", ")]).write.mode("append").json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).json(path)


def write_gold(rows: DataFrame, path: str) -> None:
    """Rows (the columns of ``GOLD``) as one file in order of URL; all of it appears at once, or nothing."""
    rows.coalesce(1).sortWithinPartitions("url").write.mode("overwrite").json(path)


def write_sheet(rows: DataFrame, columns: list[str], path: str) -> None:
    """A sheet of tabs with a header, in order of URL. Tabs and line breaks in cells become spaces."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\\t\\r\\n]+", " ").alias(c)
    rows.select(*[cell(c) for c in columns]).coalesce(1).sortWithinPartitions("url").write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def read_sheet(spark: SparkSession, columns: list[str], path: str) -> DataFrame:
    """The sheet's rows, empty cells as empty strings. A sheet with other columns is an error."""
    got = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    if got.columns != columns:
        raise ValueError(f"the sheet has columns {got.columns}, not {columns}")
    return got.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])
