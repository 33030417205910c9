"""URL filters and the rule-based page gates, as Column expressions over URL and page facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions import constants as K
from jobloom.functions import identity, urls
from jobloom.functions.text import fold, vocabulary_groups


def chain(*checks: tuple[str, Column]) -> Column:
    """The first check that says something decides: ('pass' | 'block', condition); none: accept."""
    out = None
    for kind, condition in checks:
        verdict = F.lit(kind == "pass")
        c = F.coalesce(condition, F.lit(False))
        out = F.when(c, verdict) if out is None else out.when(c, verdict)
    return out.otherwise(True) if out is not None else F.lit(True)


def every(*checks: Column) -> Column:
    """Whether all checks pass; none at all pass too."""
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(c, F.lit(False))
    return out


def reject() -> Column:
    return F.lit(True)


def content_filter(title: Column, body: Column, title_checks: list, body_checks: list) -> Column:
    """Whether a page's title and text each pass all their checks, which are functions of a column."""
    return every(*[c(title) for c in title_checks], *[c(body) for c in body_checks])


def url_filter(url: Column, blocked_segments: list[str], blocked_subdomains: list[str], blocked_extensions: list[str], blocked_hosts: list[str], blocked_params: list[str]) -> Column:
    """Invalid, TLD, passing subdomain and segment, then the blocks, in this order."""
    labels = F.split(urls.host(url), r"\.")
    sub = F.when(F.size(labels) > 2, F.slice(labels, F.lit(1), F.size(labels) - 2)).otherwise(F.array().cast("array<string>"))
    inside = lambda arr, values: F.arrays_overlap(arr, F.array(*[F.lit(v) for v in values])) if values else F.lit(False)
    keys = F.transform(F.split(urls.query(url), "&"), lambda p: F.lower(F.substring_index(p, "=", 1)))
    exact, prefixes = [p for p in blocked_params if not p.endswith("*")], [p[:-1] for p in blocked_params if p.endswith("*")]
    param = F.exists(keys, lambda k: k.isin(exact)) if exact else F.lit(False)
    if prefixes:
        param = param | F.exists(keys, lambda k: F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(k, p)))
    return chain(
        ("block", ~(url.rlike(r"^(http|/|$)") & urls.parses(url))),
        ("block", ~F.element_at(labels, -1).isin(K.ALLOWED_TLDS)),
        ("pass", inside(sub, K.PASS_SUBDOMAINS)),
        ("pass", inside(urls.segments(url), K.PASS_SEGMENTS)),
        ("block", inside(sub, blocked_subdomains)),
        ("block", inside(urls.segments(url), blocked_segments)),
        ("block", urls.extension(url).isin(blocked_extensions)),
        ("block", urls.host(url).isin(blocked_hosts)),
        ("block", param),
    )


def _word_tokens(s: Column) -> Column:
    return F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def posting_url(url: Column) -> Column:
    """Whether a URL looks like one posting: a job word in the host or in a segment before the
    last, or a long last segment with a posting noun. Without a path it does not."""
    segs = urls.segments(url)
    words = F.array(*[F.lit(w) for w in K.POSTING_WORDS])
    before = F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0)))
    last = _word_tokens(F.element_at(segs, -1))
    slug = (F.size(last) >= K.ROLE_SLUG_MIN_TOKENS) & F.arrays_overlap(last, F.array(*[F.lit(w) for w in K.POSTING_NOUNS]))
    hit = F.arrays_overlap(_word_tokens(urls.host(url)), words) | F.exists(before, lambda s: F.arrays_overlap(_word_tokens(s), words)) | slug
    return F.when(F.size(segs) == 0, False).otherwise(F.coalesce(hit, F.lit(False)))


def is_hub_or_root(url: Column) -> Column:
    """A root, a bare locale, or a last segment that names an index."""
    segs = F.transform(urls.segments(url), lambda s: F.regexp_replace(F.lower(s), r"\.(html?|php|aspx?|jsp)$", ""))
    last = F.element_at(segs, -1)
    return F.when(F.size(segs) == 0, True).when((F.size(segs) == 1) & urls.is_locale_segment(segs[0]), True).otherwise(last.isin(K.TERMINAL_HUB_WORDS + K.INDEX_TERMINALS))


def strong_title(title: Column) -> Column:
    lead = F.regexp_extract(F.lower(F.trim(title)), "^[a-z]+", 0)
    return F.exists(F.array(*[F.lit(r) for r in K.STRONG_TITLE_ROOTS]), lambda r: F.startswith(lead, r))


def title_announces_vacancy(title: Column) -> Column:
    low = F.lower(title)
    return F.contains(low, F.lit(K.VACANCY_TITLES[0])) | F.contains(low, F.lit(K.VACANCY_TITLES[1])) | F.array_contains(_word_tokens(title), K.VACANCY_TITLE_WORD)


def apply_affordance(body: Column) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in K.APPLY_PHRASES]), lambda p: F.contains(body, p))


def role_designation(title: Column) -> Column:
    return fold(title).rlike(r"\(\s*[mwfd]\s*[/|:]\s*[mwfdx]\s*([/|:]\s*[mwfdx]\s*)?\)")


def posting_path(url: Column) -> Column:
    """Whether a path goes on below a segment that names jobs and does not end in a hub."""
    segs = F.transform(urls.segments(url), lambda s: F.lower(s))
    before = F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0)))
    return F.exists(before, lambda s: s.isin(K.JOB_PATH_SEGMENTS)) & ~F.coalesce(F.try_element_at(segs, F.lit(-1)).isin(K.TERMINAL_HUB_WORDS), F.lit(False))


def saturation(links: Column, k: int) -> Column:
    return F.lit(0.0) if k <= 0 else F.least(links.cast("double") / k, F.lit(1.0))


def confidence(url: Column, title: Column, links: Column, embed: Column, jsonld_index: Column) -> Column:
    text = F.concat_ws(" ", F.lower(url), F.lower(title))
    keyword = F.exists(F.array(*[F.lit(w) for w in K.CAREER_KEYWORDS]), lambda w: F.contains(text, w))
    path_hit = F.exists(urls.segments(url), lambda s: F.lower(s).isin(K.CAREER_PATH_SIGNALS))
    add = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return add(embed, K.EMBED_WEIGHT) + add(keyword, K.KEYWORD_WEIGHT) + add(strong_title(title) | path_hit, K.TITLE_WEIGHT) + K.LINK_WEIGHT * saturation(links, K.LINK_SATURATION) + add(jsonld_index, K.JSONLD_WEIGHT)


def gate(url: Column, title: Column, links: Column, embed: Column, jsonld_index: Column) -> Column:
    """struct(accept, certain) of a page: what its host and path say, else its score."""
    segs = F.transform(urls.segments(url), lambda s: F.lower(s))
    verdict = lambda a, c: F.struct(F.lit(a).alias("accept"), F.lit(c).alias("certain"))
    kind = identity.role(url)
    score = confidence(url, title, links, embed, jsonld_index)
    return (
        F.when(identity.is_aggregator(url), verdict(False, True)).when(kind == "career_page", verdict(True, True)).when(kind == "job_listing", verdict(False, False))
        .when(F.exists(segs, lambda s: s.isin(K.REJECT_PATH_SIGNALS)), verdict(False, False)).when(posting_path(url), verdict(False, False))
        .when(F.try_element_at(segs, F.lit(-1)).isin(K.CAREER_PATH_SIGNALS), verdict(True, True)).when(score >= K.CERTAIN, verdict(True, True))
        .when(score <= K.REJECT, verdict(False, False)).otherwise(verdict(True, False)))


def positive_evidence(url: Column, title: Column, body: Column, lone_posting: Column) -> Column:
    low = F.lower(body)
    groups = vocabulary_groups(low)
    return F.coalesce(posting_url(url), F.lit(False)) | lone_posting | title_announces_vacancy(title) | (groups >= 4) | ((groups >= 2) & (apply_affordance(low) | role_designation(title)))


def extract_rung(url: Column, links: Column, embed: Column, openings_index: Column, evidence: Column, k: int = K.LINK_SATURATION) -> Column:
    """Why a page is not read for a posting: the first rung that holds it back, '' if none.
    Postings on a known board are always read."""
    kind = identity.role(url)
    segs = F.transform(urls.segments(url), lambda s: F.lower(s))
    last = F.try_element_at(segs, F.lit(-1))
    bare = F.regexp_replace(last, r"\.(html?|php|aspx?|jsp)$", "")
    signal = lambda words: F.exists(segs, lambda s: s.isin(words))
    below_jobs = F.exists(F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0))), lambda s: s.isin(K.JOB_PATH_SEGMENTS))
    root = (F.size(segs) == 0) | ((F.size(segs) == 1) & urls.is_locale_segment(F.get(segs, F.lit(0))))
    held = [
        kind == "career_page", root, bare.isin(K.TERMINAL_HUB_WORDS + K.INDEX_TERMINALS), signal(K.REJECT_PATH_SIGNALS), ~below_jobs & signal(K.CAREER_PATH_SIGNALS), embed, openings_index,
        saturation(links, k) >= 1, ~evidence]
    first = F.coalesce(*[F.when(c, rung) for c, rung in zip(held, K.RUNGS, strict=True)], F.lit(""))
    return F.when(kind == "job_listing", "").otherwise(first)


def withdrawn(body: Column, declared: Column) -> Column:
    """Whether a page withdraws its posting: by a phrase, or by showing far less, in bytes, than the
    description it declares. Both are flattened texts."""
    shown, said = F.octet_length(F.coalesce(body, F.lit(""))), F.octet_length(F.coalesce(declared, F.lit("")))
    phrase = F.exists(F.array(*[F.lit(p) for p in K.CLOSURE_PHRASES]), lambda p: F.contains(F.lower(body), p))
    short = (said > 0) & ((shown == 0) | (said > K.MAX_DECLARED_RATIO * shown))
    return F.coalesce(phrase, F.lit(False)) | short
