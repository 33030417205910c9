"""Robots rules: what hosts allow, as rows that URLs are joined with."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions import urls
from jobloom.functions.identity import hostname

RULES = "host string, allow boolean, pattern string"


def parse_rules(text: str | None, agent: str) -> list[tuple[bool, str]]:
    """(allow, pattern) of the groups for this agent, else of those for all. Empty patterns say nothing."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    names: list[str] = []
    reading_names = False
    for line in (text or "").splitlines():
        m = re.match(r"\s*([A-Za-z-]+)\s*:\s*([^#]*?)\s*(?:#.*)?$", line)
        if not m:
            continue
        field, value = m[1].lower(), m[2]
        if field == "user-agent":
            names = [*names, value.lower()] if reading_names else [value.lower()]
            reading_names = True
            for n in names:
                groups.setdefault(n, [])
        elif field in ("allow", "disallow"):
            reading_names = False
            for n in names:
                groups[n] += [(field == "allow", value)] if value else []
    mine = [g for n, g in groups.items() if n != "*" and n and n in agent.lower()]
    return [r for g in mine for r in g] if mine else groups.get("*", [])


def rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, allow, pattern) of ``files`` (host, status, body). A missing file (404, 410) allows all, which is no row;
    one that the host fails to give (5xx, or no status) forbids all."""

    def parsed(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for host, status, body in zip(*[batch.column(c).to_pylist() for c in ("host", "status", "body")], strict=True):
                if status is None or status >= 500:
                    rows.append((host, False, "/"))
                elif status not in (404, 410):
                    rows += [(host, *r) for r in parse_rules(body, agent)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.string())], names=["host", "allow", "pattern"])

    return files.select("host", "status", "body").mapInArrow(parsed, RULES)


def allowed(pages: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """(url, allowed) of different URLs of ``pages`` (url): the longest pattern that fits decides, of equal ones that which
    allows; without any, the URL is allowed. ``*`` fits everything, ``$`` the end."""
    rows = pages.select("url").distinct().withColumn("host", hostname(F.col("url")))
    q = urls.query(F.col("url"))
    rows = rows.withColumn("target", F.concat(F.when(urls.path(F.col("url")) == "", "/").otherwise(urls.path(F.col("url"))), F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))
    # Quote all, then give the two signs their meaning.
    quoted = F.regexp_replace("pattern", r"([\\.\[\]{}()+?^|$*])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.replace(quoted, F.lit(r"\*"), F.lit(".*")), r"\\\$$", r"\$"))
    own = rule_rows.select("host", "allow", "pattern", regex.alias("regex"))
    fits = rows.join(own, "host").filter(F.expr("target RLIKE regex"))
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("pattern").alias("n"), "allow"))["allow"].alias("allow"))
    return rows.select("url").join(best, "url", "left").select("url", F.coalesce("allow", F.lit(True)).alias("allowed"))
