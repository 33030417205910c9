"""Ranked, filtered, fuzzy keyword search over a corpus of listings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import constants as K
from jobloom.functions.identity import with_once
from jobloom.functions.text import strict_word_similarity, tokens

TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.4


@dataclass
class ListingQuery:
    keywords: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    arrangements: list[str] = field(default_factory=list)
    include_closed: bool = False
    fuzzy: bool = True
    sort: str = "relevance"  # or recent, found
    limit: int = K.SEARCH_LIMIT
    offset: int = 0


def of_saved_search(saved: dict, include_closed: bool = False) -> ListingQuery:
    """The query of a saved search (keywords, countries, work_arrangements): its facets, the default order and page."""
    return ListingQuery(list(saved.get("keywords") or []), list(saved.get("countries") or []), list(saved.get("work_arrangements") or []), include_closed)


def valid_saved_search(name: str, countries: list[str], arrangements: list[str]) -> dict:
    """Facets of a saved search as they are stored; a blank name, a country that is not two letters and an
    arrangement that is not one of four are errors."""
    if not name.strip():
        raise ValueError("a saved search needs a name")
    countries, arrangements = [c.strip().upper() for c in countries], [a.strip().lower() for a in arrangements]
    if bad := [c for c in countries if not re.fullmatch("[A-Z]{2}", c)]:
        raise ValueError(f"countries are two letters, not {bad}")
    if bad := [a for a in arrangements if a not in K.ARRANGEMENTS]:
        raise ValueError(f"unknown work arrangements {bad}")
    return {"name": name.strip(), "countries": countries, "work_arrangements": arrangements}


def recent_limit(limit: int | None) -> int:
    """How many rows the recent feed shows: as asked from 1 to the most, the default without a wish."""
    return K.RECENT_LIMIT if limit is None else max(1, min(limit, K.RECENT_MAX))


def _terms(keyword: str) -> list[tuple[bool, list[str]]]:
    """(negated, words) of each term; words in quotes are one phrase."""
    out = []
    for m in re.finditer(r'(-?)(?:"([^"]*)"|(\S+))', keyword):
        words = re.findall(r"[^\W_]+", (m[2] if m[2] is not None else m[3]).lower())
        if words:
            out.append((m[1] == "-", words))
    return out


def _has(words: list[str], toks: Column) -> Column:
    """All words, next to each other in this order if there are several."""
    if len(words) == 1:
        return F.array_contains(toks, words[0])
    return F.contains(F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")), F.lit(" " + " ".join(words) + " "))


def keyword_match(keyword: str, title_toks: Column, body_toks: Column) -> Column:
    """All terms of one keyword, in title or body; ``or`` between terms gives alternatives;
    a minus sign excludes."""
    alternatives, current = [], F.lit(True)
    for negated, words in _terms(keyword):
        if words == ["or"] and not negated:
            alternatives.append(current)
            current = F.lit(True)
            continue
        hit = _has(words, title_toks) | _has(words, body_toks)
        current = current & (~hit if negated else hit)
    for a in alternatives:
        current = a | current
    return current


def rank(keywords: list[str], title_toks: Column, body_toks: Column) -> Column:
    """Sum over different positive terms: 1 in the title, 0.4 in the body."""
    words = sorted({tuple(w) for k in keywords for negated, w in _terms(k) if not negated and w != ["or"]})
    score = F.lit(0.0)
    for w in words:
        score = score + F.when(_has(list(w), title_toks), TITLE_WEIGHT).otherwise(0.0) + F.when(_has(list(w), body_toks), BODY_WEIGHT).otherwise(0.0)
    return score


def search_listings(corpus: DataFrame, q: ListingQuery) -> DataFrame:
    """Listings (id, title, description, country, work_arrangement, first_seen, last_seen,
    closed_at) that match all keywords, each exactly or by a title that is close to it.

    Facets that are not given add no predicate. Ties are broken by id, so pages of results
    are stable; the top is taken without a global sort.
    """
    keywords = [k.strip() for k in q.keywords if k.strip()]
    rows = corpus if q.include_closed else corpus.filter(F.col("closed_at").isNull())
    if q.countries:
        rows = rows.filter(F.col("country").isin([c.upper() for c in q.countries]))
    if q.arrangements:
        rows = rows.filter(F.col("work_arrangement").isin(q.arrangements))
    order = [F.desc("first_seen"), "id"] if q.sort == "found" else [F.desc("last_seen"), "id"]
    rows = rows.withColumn("rank", F.lit(0.0))
    if keywords:
        title, body = tokens(F.coalesce("title", F.lit(""))), tokens(F.coalesce("description", F.lit("")))
        rows = with_once(rows, title_toks=title, body_toks=body)
        exact = F.lit(True)
        for k in keywords:
            hit = keyword_match(k, F.col("title_toks"), F.col("body_toks"))
            if q.fuzzy:
                hit = hit | (strict_word_similarity(k, F.col("title")) >= K.FUZZY_THRESHOLD)
            rows = rows.filter(hit)
            exact = exact & keyword_match(k, F.col("title_toks"), F.col("body_toks"))
        # What only a close title has let in ranks below all exact matches.
        rows = rows.withColumn("rank", F.round(F.when(exact, rank(keywords, F.col("title_toks"), F.col("body_toks"))).otherwise(0.0), 4))
        if q.sort == "relevance":
            order = [F.desc("rank"), F.desc("last_seen"), "id"]
    rows = rows.orderBy(*order).offset(max(0, q.offset)).limit(q.limit if q.limit > 0 else K.SEARCH_LIMIT)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("id", text("title"), text("country"), "work_arrangement", "first_seen", "last_seen", "closed_at", "rank")
