"""Pages to content: title, main text, links, embeds, ids, JSON-LD, site name; postings in JSON-LD.

HTML and JSON-LD are recursive, so they are parsed in Python, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame

CONTENT = "title string, main_content string, urls array<string>, jsonld array<string>, site_name string, embeds array<struct<src:string,is_frame:boolean>>, element_ids array<string>, title_text string"
_SKIP = {"script", "style", "noscript", "svg", "template"}
_CHROME = {"nav", "header", "footer", "aside"}
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_REGIONS = ("main", "role", "content", "article")

#: What a start tag ends if it is still open, unless one of the elements behind it has been opened since:
#: end tags that HTML lets pages leave out.
_ITEMS, _TABLES = ("ul", "ol", "menu", "dir"), ("table",)
_SCOPE = ("table", "td", "th", "caption", "button", "object", "template")
_IMPLIED = {
    "li": (("li",), _ITEMS), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")), "optgroup": (("optgroup", "option"), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), _TABLES), **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot", "tr"), _TABLES)),
    **dict.fromkeys("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), (("p",), _SCOPE)),
}


class _Reader(HTMLParser):
    """One pass, in time by the length of the page: of the open elements it keeps where each tag is open,
    so nothing ever walks over all of them. Text is kept with the regions it stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # of each tag, in ``open``
        self.inside: Counter[str] = Counter()  # open elements by region, and of "skip" and "chrome"
        self.regions: frozenset[str] = frozenset()
        self.titles, self.h1, self.text = [], [], []
        self.urls, self.jsonld, self.embeds, self.ids, self.site = [], [], [], [], ""
        self.ld: list[str] | None = None
        self.read: set[str] = set()  # of title and h1 the first counts

    def is_open(self, tag: str) -> bool:
        return bool(self.places[tag])

    def _count(self, tag: str, region: str | None, by: int) -> None:
        if tag in _SKIP:
            self.inside["skip"] += by
        if tag in _CHROME:
            self.inside["chrome"] += by
        if region:
            self.inside[region] += by
            self.regions = frozenset(r for r in _REGIONS if self.inside[r])

    def pushed(self, tag: str, a: dict[str, str]) -> None:
        """An element has been opened; it is not yet among the open ones."""

    def popped(self, tag: str) -> None:
        """An element is about to be closed; it is still among the open ones."""

    def _close_from(self, at: int) -> None:
        while len(self.open) > at:
            tag, region = self.open[-1]
            self.popped(tag)
            self.open.pop()
            self.places[tag].pop()
            self._count(tag, region, -1)
            if tag == "h1" or (tag == "title" and not self.is_open("svg")):
                self.read.add(tag)

    def _end_implied(self, tag: str) -> None:
        ended, kept_by = _IMPLIED.get(tag, ((), ()))
        last = lambda tags: max((self.places[t][-1] for t in tags if self.places[t]), default=-1)
        limit = last(kept_by)
        first = min((p for t in ended for p in self.places[t][-1:] if p > limit), default=-1)
        if first >= 0:
            self._close_from(first)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        self._end_implied(tag)
        if "id" in a:
            self.ids.append(a["id"])
        if tag == "a" and "href" in a:
            self.urls.append(a["href"])
        if tag in ("iframe", "script") and a.get("src"):
            self.embeds.append({"src": a["src"], "is_frame": tag == "iframe"})
        if tag == "script" and a.get("type", "").strip().lower() == "application/ld+json":
            self.ld = []
        if tag == "meta" and a.get("property") == "og:site_name" and not self.site:
            self.site = a.get("content", "").strip()
        self.pushed(tag, a)
        if tag in _VOID:
            return
        region = "main" if tag == "main" else "role" if tag == "div" and a.get("role") == "main" else "content" if tag == "div" and a.get("id") == "content" else "article" if tag == "article" else None
        self.places[tag].append(len(self.open))
        self.open.append((tag, region))
        self._count(tag, region, 1)

    def handle_endtag(self, tag):
        if tag == "script" and self.ld is not None:
            self.jsonld.append("".join(self.ld).strip())
            self.ld = None
        if self.places[tag]:
            self._close_from(self.places[tag][-1])

    def close(self):
        super().close()
        self._close_from(0)

    def handle_data(self, data):
        if self.ld is not None:
            self.ld.append(data)
        if self.is_open("title") and not self.is_open("svg"):
            if "title" not in self.read:
                self.titles.append(data)
        elif not self.inside["skip"]:
            if self.is_open("h1") and "h1" not in self.read:
                self.h1.append(data)
            self.text.append((data, self.regions, self.inside["chrome"] > 0))


def one_line(parts: list[str]) -> str:
    """Texts as the page runs them together, with white space collapsed."""
    return _SPACE.sub(" ", "".join(parts)).strip(" ")


def main_region(parts: list[tuple]) -> list:
    """Those items of (item, regions, in chrome) that stand in a page's main region: its first kind there
    is, else the page without its chrome, else all of it."""
    for region in _REGIONS:
        if any(region in regions for _, regions, _ in parts):
            return [x for x, regions, _ in parts if region in regions]
    return [x for x, _, chrome in parts if not chrome]


def parse_page(html: str | None) -> dict:
    """The content of a page; empty for null. ``title_text`` is what the page's title element holds, white space included, and
    null for null."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    main = one_line(main_region(r.text)) or one_line([t for t, _, _ in r.text])
    return {"title": one_line(r.titles) or one_line(r.h1), "main_content": main, "urls": r.urls, "jsonld": r.jsonld, "site_name": r.site, "embeds": r.embeds, "element_ids": r.ids, "title_text": None if html is None else "".join(r.titles)}


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, <content>) of each row of ``pages`` (page_id, url, html)."""
    import pyarrow as pa

    fields = [
        ("title", pa.string()), ("main_content", pa.string()), ("urls", pa.list_(pa.string())), ("jsonld", pa.list_(pa.string())), ("site_name", pa.string()),
        ("embeds", pa.list_(pa.struct([("src", pa.string()), ("is_frame", pa.bool_())]))), ("element_ids", pa.list_(pa.string())), ("title_text", pa.string()),
    ]

    def parsed(batches):
        for batch in batches:
            rows = [parse_page(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *[pa.array([r[n] for r in rows], t) for n, t in fields]], names=["page_id", "url", *[n for n, _ in fields]])

    return pages.select("page_id", "url", "html").mapInArrow(parsed, "page_id long, url string, " + CONTENT)


_TAG = re.compile("<[^>]*>")


def plain(text: str) -> str:
    """Text of what may be markup, escaped or not, as :func:`jobloom.functions.markup.encoded_somehow`."""
    return " ".join(_TAG.sub(" ", unescape(_TAG.sub(" ", text))).split())


def _text(x) -> str:
    """The first non-empty text of a string, an object's name, or a list of these."""
    if isinstance(x, str):
        return plain(x)
    if isinstance(x, dict):
        return _text(x.get("name"))
    if isinstance(x, list):
        return next((t for t in map(_text, x) if t), "")
    return ""


def _place(x) -> tuple[str, str]:
    """(location, country) of a place, an address, its text, or the first of a list of these that says any."""
    if isinstance(x, list):
        return next((p for p in map(_place, x) if p[0]), ("", ""))
    return _address(x.get("address")) if isinstance(x, dict) else ("", "")


def _address(x) -> tuple[str, str]:
    if isinstance(x, list):
        return next((a for a in map(_address, x) if a[0]), ("", ""))
    if isinstance(x, dict):
        parts = [_text(x.get(k)) for k in ("addressLocality", "addressRegion", "addressCountry")]
        return ", ".join(p for p in parts if p), parts[2]
    return (plain(x), "") if isinstance(x, str) else ("", "")


def _is_type(node: dict, name: str) -> bool:
    kinds = node.get("@type")
    return any(isinstance(k, str) and k.lower() == name for k in (kinds if isinstance(kinds, list) else [kinds]))


def scan_jsonld(blocks: list[str]) -> dict:
    """How many postings the blocks hold at any depth, whether a list holds some, and the
    fields of the first: title, location, country, description, remote."""
    postings, in_list = [], False
    stack = []
    for b in blocks or []:
        try:
            stack.append((json.loads(b), False))
        except (ValueError, RecursionError):
            continue
    stack.reverse()
    while stack:
        node, listed = stack.pop()
        if isinstance(node, list):
            stack += [(x, listed) for x in reversed(node)]
        elif isinstance(node, dict):
            listed = listed or _is_type(node, "itemlist")
            if _is_type(node, "jobposting"):
                postings.append(node)
                in_list = in_list or listed
            stack += [(v, listed) for v in reversed(list(node.values())) if isinstance(v, (dict, list))]
    first = postings[0] if postings else {}
    location, country = _place(first.get("jobLocation"))
    said, kind = first.get("description"), first.get("jobLocationType")
    return {
        "postings": len(postings), "in_list": in_list, "title": _text(first.get("title")), "location": location, "country": country, "description": plain(said) if isinstance(said, str) else "",
        "remote": any(isinstance(k, str) and "telecommute" in k.lower() for k in (kind if isinstance(kind, list) else [kind])),
    }


def has_openings_index(scan: dict) -> bool:
    """Whether structured data holds a list of postings or several postings, as an index of openings does."""
    return scan["in_list"] or scan["postings"] > 1


def stratum(scan: dict) -> str:
    """none, lone (one posting with a title, outside lists) or ambiguous."""
    if not scan["postings"]:
        return "none"
    return "lone" if scan["postings"] == 1 and not scan["in_list"] and scan["title"] else "ambiguous"


def _is_organization(node: dict) -> bool:
    kinds = node.get("@type")
    return any(isinstance(k, str) and "organization" in k.lower() for k in (kinds if isinstance(kinds, list) else [kinds]))


def _named_values(block, key: str):
    """Values under ``key``, graphs first, in the order of the block's lists."""
    for node in block if isinstance(block, list) else [block]:
        if isinstance(node, list):
            yield from _named_values(node, key)
        elif isinstance(node, dict):
            if "@graph" in node:
                yield from _named_values(node["@graph"], key)
            if key == "@type" and _is_organization(node):
                yield node
            elif key in node and key != "@type":
                yield node[key]


def _own_name(x) -> str:
    """The text, or an organization's name, or the first of a list of these."""
    if isinstance(x, list):
        return next((n for n in map(_own_name, x) if n), "")
    x = x.get("name") if isinstance(x, dict) else x
    return x.strip() if isinstance(x, str) else ""


def _own_host(node) -> str:
    from urllib.parse import urlsplit

    if not isinstance(node, dict):
        return next((h for h in map(_own_host, node) if h), "") if isinstance(node, list) else ""
    if not _is_organization(node):
        return ""
    for key in ("url", "sameAs"):
        for value in node[key] if isinstance(node.get(key), list) else [node.get(key)]:
            try:
                host = urlsplit(value).hostname if isinstance(value, str) else None
            except ValueError:
                continue
            if host:
                return host
    return ""


def organization(blocks: list[str] | None) -> dict:
    """Name and host of the company in JSON-LD: who hires, before any other organization."""
    parsed = []
    for b in blocks or []:
        try:
            parsed.append(json.loads(b))
        except (ValueError, RecursionError):
            continue
    found = [list(_named_values(b, key)) for key in ("hiringOrganization", "@type") for b in parsed]
    values = [v for vs in found for v in vs]
    return {"name": next((n for n in map(_own_name, values) if n), ""), "host": next((h for h in map(_own_host, values) if h), "")}


def openings_indexes(pages: DataFrame) -> DataFrame:
    """(page_id, openings_index) of parsed pages (page_id, jsonld)."""

    def found(batches):
        import pyarrow as pa

        for batch in batches:
            marks = [has_openings_index(scan_jsonld(b)) for b in batch.column("jsonld").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(marks, pa.bool_())], names=["page_id", "openings_index"])

    return pages.select("page_id", "jsonld").mapInArrow(found, "page_id long, openings_index boolean")


def organizations(pages: DataFrame) -> DataFrame:
    """(page_id, organization, organization_host) of parsed pages (page_id, jsonld)."""

    def found(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [organization(b) for b in batch.column("jsonld").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([r["name"] for r in rows], pa.string()), pa.array([r["host"] for r in rows], pa.string())], names=["page_id", "organization", "organization_host"])

    return pages.select("page_id", "jsonld").mapInArrow(found, "page_id long, organization string, organization_host string")
