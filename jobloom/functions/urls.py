"""URL functions as Column expressions, none of which fails on a malformed URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions import constants as K


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def parses(url: Column) -> Column:
    """Whether a URL, absolute or relative, can be parsed: no control characters, no broken escapes before its query, a host
    without spaces, a port of digits."""
    authority, before = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.substring_index(F.substring_index(url, "#", 1), "?", 1)
    broken = url.rlike("[\\x00-\\x1f\\x7f]") | before.rlike("%(?![0-9A-Fa-f]{2})") | authority.rlike(r"[\s<>\"{}|\\^`]") | authority.rlike(r":[^\]:]*[^0-9:\]][^\]:]*$") | url.rlike("^:")
    return F.coalesce(~broken, F.lit(False))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def _trimmed(p: Column) -> Column:
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)


def _kept_query(url: Column, drop) -> Column:
    """Parameters that stay, in order of their keys; those of one key keep their order."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p != "")
    key = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(pairs, lambda p: ~drop(F.lower(key(p))))
    named = F.transform(kept, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    text = F.array_join(F.transform(F.array_sort(named), lambda x: x["p"]), "&")
    return F.when(text != "", F.concat(F.lit("?"), text)).otherwise("")


def _is_url(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]")


def frontier_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no trackers, sorted query, no closing slash."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = _kept_query(url, lambda k: k.isin(K.FRONTIER_TRACKERS) | k.startswith("utm_"))
    return F.when(_is_url(url), F.concat(scheme, F.lit("://"), host(url), _trimmed(path(url)), rest)).otherwise(url)


def listing_url(url: Column) -> Column:
    """The identity of a listing: https, no www., no fragment, fewer trackers, sorted query."""
    rest = _kept_query(url, lambda k: k.isin(K.LISTING_TRACKERS))
    return F.when(_is_url(url), F.concat(F.lit("https://"), F.regexp_replace(host(url), r"^www\.", ""), _trimmed(path(url)), rest)).otherwise(url)


def page_url(url: Column) -> Column:
    """The identity of a page: https, no query, no closing slash."""
    return F.when(_is_url(url), F.concat(F.lit("https://"), host(url), F.regexp_replace(path(url), "/+$", ""))).otherwise(url)


def ats_listing_id(provider: Column, tenant: Column, source_id: Column) -> Column:
    return F.concat_ws(":", F.lower(provider), F.lower(tenant), source_id)


def is_locale_segment(segment: Column) -> Column:
    return F.lower(segment).isin(K.LOCALES)


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"\.([^./]*)$", 1))


def has_path_prefix(url: Column, prefix: Column) -> Column:
    """Whether ``prefix`` is all of ``url`` or ends at a boundary of its path."""
    after = F.substring(url, F.length(prefix) + 1, F.lit(1))
    return F.startswith(url, prefix) & (after.isin("", "/") | F.endswith(prefix, F.lit("/")))


def row_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 12)


def seeded_hash(seed: str, url: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed + "\n"), url), 256)
