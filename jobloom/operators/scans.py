"""Plain readings of the catalog's tables, in the order that their users expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_first(rows: DataFrame, when: str, *ties: str) -> DataFrame:
    """All rows, the newest first; ties in the order of these columns."""
    return rows.orderBy(F.desc(when), *ties)


def oldest_first(rows: DataFrame, when: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.asc(when), *ties)


def by_keys(rows: DataFrame, key: str, keys: list) -> DataFrame:
    """The rows with one of these keys, such as a run's id, or statuses; none for no keys."""
    return rows.filter(F.col(key).isin(keys)) if keys else rows.limit(0)


def open_listings(listings: DataFrame, page) -> DataFrame:
    """Open listings of a page in the order in which they were first seen, without their descriptions."""
    return listings.filter((F.col("career_page_id") == page) & F.col("closed_at").isNull()).drop("description").orderBy("first_seen", "canonical_url")


def by_name(companies: DataFrame) -> DataFrame:
    """Companies by name, else by domain, without regard to case and accents; ties by key."""
    shown = F.coalesce(F.nullif("name", F.lit("")), "display_domain")
    return companies.orderBy(F.collate(shown, "UNICODE_CI_AI"), "company_key")


def catalog_view(companies: DataFrame, source: str = "all", unverified_only: bool = False, letter: str = "all") -> DataFrame:
    """Companies (company_key, name, display_domain, ats_provider, name_source) as a catalog page shows them: of boards
    (``ats``) or their own sites (``self``), without a name that structured data vouches for, and by the first letter
    of their name. A letter that no company has is as good as none."""
    from jobloom.functions.text import initial

    provider, kind = F.coalesce("ats_provider", F.lit("")), F.coalesce("name_source", F.lit(""))
    rows = companies.filter(provider != "") if source == "ats" else companies.filter(provider == "") if source == "self" else companies
    if unverified_only:
        rows = rows.filter(~kind.isin("jsonld", "meta"))
    if letter != "all":
        mine: Column = initial(F.coalesce(F.nullif("name", F.lit("")), "display_domain")) == letter
        if not rows.filter(mine).isEmpty():
            rows = rows.filter(mine)
    return by_name(rows)
