"""Who owns a URL: job-board rules, registrable domains, roles of URLs, as Column expressions.

Functions that need the board take it as ``b`` where a plan has it in a column already, so
that it is worked out once a row and the plan stays small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import constants as K
from jobloom.functions import urls


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once a row. The optimizer copies large expressions
    into the filters and projections above them; it does not through a generator of one row."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def hostname(url: Column) -> Column:
    """The host of a URL without user and port; empty if it has none."""
    return F.regexp_replace(F.regexp_replace(urls.host(url), "^.*@", ""), ":[0-9]*$", "")


def registrable_domain(host: Column, long_suffixes: list[str] = K.LONG_SUFFIXES, generic: list[str] = K.GENERIC_LABELS, flat: list[str] = K.FLAT_DOMAINS) -> Column:
    """The public suffix and one label; the host itself if it is an address or has no more. A suffix has two labels if it is
    a long one, or if a generic label stands under a country's domain that is not flat; else one."""
    labels = F.split(host, r"\.")
    top, second = F.element_at(labels, -1), F.substring_index(F.substring_index(host, ".", -2), ".", 1)
    national = top.rlike("^[a-z]{2}$") & ~top.isin(flat) & second.isin(generic)
    n = F.when(national | F.substring_index(host, ".", -2).isin(long_suffixes), 3).otherwise(2)
    return F.when(host.rlike(r"^[0-9.]+$|:") | (F.size(labels) <= n), host).otherwise(F.array_join(F.slice(labels, -n, n), "."))


def _lower_segment(url: Column, i: Column) -> Column:
    return F.lower(F.get(urls.segments(url), i))


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A literal map keeps the expression small, however many boards there are."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


_BY_HOST = {h: provider for provider, hosts, _ in K.BOARD_HOSTS for h in hosts}
_PREFIXES = {h: prefix for _, hosts, prefix in K.BOARD_HOSTS for h in hosts if prefix}
_BY_SUFFIX = {suffix: provider for provider, suffix, _ in K.BOARD_SUFFIXES}
_OWN_HOSTS = [f"{label}.{suffix}" for _, suffix, own in K.BOARD_SUFFIXES for label in own]


def _suffix_board(host: Column) -> tuple[Column, Column]:
    """(provider, label) by the suffix of a host, of three labels or two. The label next to it is
    the company's, unless it is the board's own; then both are null."""
    last = lambda n: F.substring_index(host, ".", -n)
    by3, by2 = _lookup(_BY_SUFFIX, last(3)), _lookup(_BY_SUFFIX, last(2))
    in3, in2 = by3.isNotNull() & (last(3) != host), by2.isNotNull() & (last(2) != host) & ~last(3).isin(_OWN_HOSTS)
    return F.when(in3, by3).when(in2, by2), F.when(in3, F.substring_index(last(4), ".", 1)).when(in2, F.substring_index(last(3), ".", 1))


def board(url: Column) -> Column:
    """struct(provider, by_path, slug, prefix) of a URL on a known job board, else null. The slug,
    which names the company, is empty where the URL has none."""
    host = hostname(url)
    by_host, prefix = _lookup(_BY_HOST, host), F.coalesce(_lookup(_PREFIXES, host), F.lit(""))
    fits = by_host.isNotNull() & ((prefix == "") | (F.coalesce(_lower_segment(url, F.lit(0)), F.lit("")) == prefix))
    by_suffix, label = _suffix_board(host)
    provider = F.when(fits, by_host).when(by_host.isNull(), by_suffix)
    slug = F.when(by_host.isNotNull(), _lower_segment(url, F.when(prefix == "", 0).otherwise(1))).otherwise(label)
    found = F.struct(provider.alias("provider"), by_host.isNotNull().alias("by_path"), F.coalesce(slug, F.lit("")).alias("slug"), prefix.alias("prefix"))
    return F.when(F.length(F.coalesce(provider, F.lit(""))) > 0, found)


def provider_of_host(host: Column) -> Column:
    """The job board that a host belongs to, else null."""
    return F.coalesce(_lookup(_BY_HOST, host), _lookup(_BY_SUFFIX, host), _suffix_board(host)[0])


def identify(url: Column, b: Column | None = None) -> Column:
    """struct(company_key, provider, politeness_domain). On a board the key is provider:slug; on
    a shared domain the host; else the registrable domain."""
    host, b = hostname(url), board(url) if b is None else b
    owner = registrable_domain(host)
    on_board = F.coalesce(b["slug"] != "", F.lit(False))
    key = F.when(on_board, F.concat_ws(":", b["provider"], b["slug"])).when(owner.isin(K.SHARED_DOMAINS), host).otherwise(owner)
    return F.struct(key.alias("company_key"), F.when(on_board, b["provider"]).otherwise("").alias("provider"), host.alias("politeness_domain"))


def role(url: Column, b: Column | None = None) -> Column:
    """career_page, job_listing, or unknown for a URL on no known board."""
    segs, b = urls.segments(url), board(url) if b is None else b
    n = F.size(segs) - F.when(F.coalesce(urls.is_locale_segment(F.try_element_at(segs, F.lit(-1))), F.lit(False)), 1).otherwise(0)
    root = F.when(b["by_path"], F.when(b["prefix"] != "", 2).otherwise(1)).otherwise(0)
    return F.when(b.isNull(), "unknown").when(n == root, "career_page").otherwise("job_listing")


def career_page_url(url: Column, b: Column | None = None) -> Column:
    """The root of the company's board that a URL is on, else null."""
    b = board(url) if b is None else b
    base = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    by_path = F.when(b["slug"] != "", F.concat_ws("/", base, F.nullif(b["prefix"], F.lit("")), b["slug"]))
    return F.when(b.isNotNull(), F.when(b["by_path"], by_path).otherwise(base))


def stored_page_url(url: Column, b: Column | None = None) -> Column:
    """What a career page is filed under: its board's root if it is on one, as a page identity."""
    return urls.page_url(F.coalesce(career_page_url(url, b), url))


def is_aggregator(url: Column) -> Column:
    return registrable_domain(hostname(url)).isin(K.AGGREGATORS)


def embed_tenant(src: Column) -> Column:
    """struct(provider, tenant) of an embedded board's source, else null."""
    provider, b = provider_of_host(hostname(src)), board(src)
    tenant = b["slug"]
    for name, param in K.EMBED_PARAMS.items():
        value = F.lower(F.trim(F.try_url_decode(F.regexp_extract(urls.query(src), rf"(?:^|&){param}=([^&]*)", 1))))
        tenant = F.when(provider == name, value).otherwise(tenant)
    return F.when(provider.isNotNull() & (tenant != ""), F.struct(provider.alias("provider"), tenant.alias("tenant")))


def has_board_embed(embeds: Column, element_ids: Column) -> Column:
    """Whether a page embeds a board: a frame from one, or a script of one and the element it fills."""

    def embeds_board(e):
        provider = provider_of_host(hostname(e["src"]))
        marked = F.lit(False)
        for name, marker in K.EMBED_MARKERS.items():
            marked = marked | ((provider == name) & F.array_contains(element_ids, marker))
        return F.coalesce(provider.isNotNull() & (e["is_frame"] | marked), F.lit(False))

    return F.coalesce(F.exists(embeds, embeds_board), F.lit(False))
