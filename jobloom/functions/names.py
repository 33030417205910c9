"""What a company is called, from the most to the least trusted source, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions import constants as K

_SEPARATOR_PATTERNS = [re.escape(s) for s in K.NAME_SEPARATORS]
_EDGE = ".,:|-–—·"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is(name: Column, cued: Column | bool) -> Column:
    return F.struct(name.alias("name"), (cued if isinstance(cued, Column) else F.lit(cued)).alias("cued"))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def only_boilerplate(name: Column) -> Column:
    """Whether each word of a name is one that any hiring page has; true of no words."""
    known = lambda w: F.btrim(w, F.lit(_EDGE)).isin(K.NAME_BOILERPLATE)
    return (name == "") | F.forall(F.split(F.lower(name), " "), known)


def _behind_connector(name: Column) -> Column:
    """What follows the last "at" of a name, and whether there is one."""
    out = None
    for c in K.NAME_CONNECTORS:
        rest = F.trim(F.regexp_extract(name, rf"(?i)^.*{re.escape(c)}(.*)$", 1))
        has = F.contains(F.lower(name), F.lit(c))
        out = F.when(has, _is(rest, True)) if out is None else out.when(has, _is(rest, True))
    return out.otherwise(_is(name, False))


def _company_part(s: Column) -> Column:
    """The first part, between separators, that is not boilerplate; the whole if all are."""
    name, out = s["name"], None
    for separator, pattern in zip(K.NAME_SEPARATORS, _SEPARATOR_PATTERNS, strict=True):
        parts = F.filter(F.transform(F.split(name, pattern), lambda p: F.trim(p)), lambda p: ~only_boilerplate(p))
        hit = (F.contains(name, F.lit(separator)), _is(F.coalesce(F.get(parts, F.lit(0)), name), True))
        out = F.when(*hit) if out is None else out.when(*hit)
    return out.otherwise(s)


def _without_suffixes(s: Column) -> Column:
    """Each suffix goes once, in their order; so a pattern has them in reverse."""
    endings = "".join(rf"({re.escape(x)})?" for x in reversed(K.NAME_SUFFIXES)) + "$"
    return _is(F.regexp_replace(s["name"], "(?i)" + endings, ""), s["cued"] | s["name"].rlike("(?i)(" + "|".join(map(re.escape, K.NAME_SUFFIXES)) + ")$"))


def _without_lead(s: Column) -> Column:
    """A hiring word in front is a cue; an article is only dropped."""
    first = F.substring_index(s["name"], " ", 1)
    rest = F.ltrim(F.substring(s["name"], F.length(first) + 1, F.length(s["name"])))
    return F.when(F.lower(first).isin(K.NAME_LEADS), _is(rest, True)).when(F.lower(first).isin(K.NAME_ARTICLES), _is(rest, s["cued"])).otherwise(s)


def stripped(name: Column) -> Column:
    """struct(name, cued) of a name on one line: without what hiring pages put around it, and whether
    anything of that kind was there."""
    return _let(_let(_let(_let(name, _behind_connector), _company_part), _without_suffixes), _without_lead)


def title_name(title: Column) -> Column:
    """The company in a page's title; null without a cue, or where nothing else is left."""
    return _let(stripped(one_line(title)), lambda s: F.when(s["cued"] & ~only_boilerplate(s["name"]), s["name"]))


def site_name(name: Column, provider: Column) -> Column:
    """The name a site gives itself, null on a job board, whose own name that would be."""
    own = lambda x: F.when(~only_boilerplate(x), x)
    inner = lambda n: F.when(~only_boilerplate(n), _let(F.btrim(stripped(n)["name"], F.lit(" " + _EDGE)), own))
    return F.when(F.coalesce(provider, F.lit("")) == "", _let(one_line(name), inner))


def company_name(organization: Column, site: Column, provider: Column, model: Column, title: Column, company_key: Column) -> Column:
    """struct(name, source): what structured data says, the site, a model, the title; else the key,
    without the board in front of it. Null and empty answers are passed over."""
    answers = {"jsonld": F.trim(organization), "meta": site_name(site, provider), "llm": one_line(model), "title": title_name(title)}
    rungs = F.array(*[F.struct(v.alias("name"), F.lit(k).alias("source")) for k, v in answers.items()])
    key = F.regexp_replace(company_key, "^[^:]*:", "")
    return F.coalesce(F.get(F.filter(rungs, lambda r: F.coalesce(r["name"], F.lit("")) != ""), F.lit(0)), F.struct(key.alias("name"), F.lit("domain").alias("source")))
