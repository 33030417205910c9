"""WARC archives: write captures as request, response and metadata records, read them back,
and assemble one nested row per capture.

Each record is a gzip member of its own, as the standard asks, and each archive starts with a
``warcinfo`` record; so other tools can read the archives, and seek in them. Records are made in
Arrow batches where the pages are read; Spark's text sink writes them to any file system,
see :func:`_member`. Payloads are not shuffled: which payloads are equal is found on digests alone,
and told to the pages by a broadcast up to a checked number of digests, else by a join in which
much-copied payloads are dealt over salts. Reading goes member by member through whole archive
files, whose size the writer bounds. Records are joined through their concurrent-to identifiers;
payloads stay out of that join unless they are asked for.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.tables import fresh_path, hot_join, table, written

MIN_REVISIT_BYTES = 1000
MAX_CAPTURES = 4000  # in one archive
MAX_BROADCAST_DIGESTS = 200_000
CAPTURED_AT = "2024-01-01T00:00:00Z"  # if the pages do not say when they were captured
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\0"  # what ends each value in the text sink; see _member

RECORD = "type string, id string, concurrent_to string, refers_to string, page_id long, uri string, digest string, payload_bytes long, payload_length long, is_null boolean, payload binary"


def _urn(*parts: object) -> str:
    """A record identifier, by rule."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(map(str, parts)).encode()).digest())}>"


def _member(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member without its last byte; headers with null values are left out.

    A member ends with its size in four bytes, the highest last, which is zero below 16 MB. Spark's
    text sink writes the bytes of a value as they are and ends it with ``END``, that very byte. For
    a larger record an empty member follows, which ends in zero too.
    """
    head = "".join(f"{name}: {value}\r\n" for name, value in [("WARC-Type", kind), *headers, ("Content-Length", len(block))] if value is not None)
    pack = lambda data: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(data) + z.flush()
    out = pack(b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n")
    return (out if out[-1:] == END else out + pack(b""))[:-1]


def _http(url: str | None) -> tuple[str, str]:
    """What a request asks for: host, and path with query."""
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return "", "/"
    return parts.netloc, (parts.path or "/") + ("?" + parts.query if parts.query else "")


def _capture(r: dict) -> list[bytes]:
    """The three records of one page, see :func:`write_archives`."""
    body, page, url = (r["html"] or "").encode(), r["page_id"], r["url"]
    url = " ".join(url.splitlines()) if url is not None else None
    digest, date = "sha1:" + r["digest"], r["at"]
    first, alone = r["first_page"], r["first_rows"] == 1
    revisit = first is not None and page != first
    # The one row that others refer to has an identifier that they can tell, too.
    own = _urn("response", first, r["digest"]) if first is not None and not revisit and alone else _urn("response", r["row"], page, r["digest"])
    request_id, host_path = _urn("request", r["row"], page, r["digest"]), _http(url)
    refers = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn("response", first, r["digest"]) if alone else None), ("WARC-Refers-To-Target-URI", r["first_url"]), ("WARC-Refers-To-Date", r["first_at"]), ("Refers-To-Page-ID", first)]
    # A revisit repeats the headers without the body, and so without its length.
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = status + b"\r\n" if revisit else status + b"Content-Length: %d\r\n\r\n" % len(body) + body
    common = [("WARC-Date", date), ("WARC-Target-URI", url)]
    response = _member(
        "revisit" if revisit else "response",
        [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), *(refers if revisit else []), ("Page-ID", page), ("Content-Type", "application/http; msgtype=response")], block)
    request = _member(
        "request", [("WARC-Record-ID", request_id), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")],
        f"GET {host_path[1]} HTTP/1.1\r\nHost: {host_path[0]}\r\n\r\n".encode("utf-8", "replace"))
    metadata = _member(
        "metadata", [("WARC-Record-ID", _urn("metadata", r["row"], page, r["digest"])), *common, ("WARC-Concurrent-To", request_id), ("Content-Type", "application/warc-fields")],
        f"payload-bytes: {len(body)}\r\npayload-digest: {digest}\r\n".encode())
    return [response, request, metadata]


def write_archives(pages: DataFrame, path: str, captured_at: str | None = None) -> None:
    """Write three records for each row of ``pages`` (page_id, url, html) to archives under
    ``path``: the response, or a revisit where an equal payload of at least
    ``MIN_REVISIT_BYTES`` bytes has a larger page_id; the request; and the metadata.

    ``captured_at`` names a timestamp column of ``pages``; without it, and for nulls, the date is
    ``CAPTURED_AT``. A null html is an empty payload; null urls and page_ids have no header. Rows
    with a null page_id revisit others but are not revisited; rows that repeat with the largest
    page_id are all responses, and their revisits name the page but no one record. Line breaks in
    urls become spaces. Payloads of any length are one record. No pages give no archives. Other
    columns are ignored.
    """
    at = F.coalesce(F.date_format(captured_at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(CAPTURED_AT)) if captured_at else F.lit(CAPTURED_AT)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), at.alias("at"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    facts = rows.filter((F.octet_length("html") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()).select("digest", "page_id", F.struct("url", "at").alias("where"))
    by_page = facts.groupBy("digest", "page_id").agg(F.count("*").alias("rows"), F.min("where").alias("where"))
    whole = rows.filter(F.octet_length("html") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.count("*").alias("n"))
    top = by_page.groupBy("digest").agg(F.max(F.struct("page_id", "rows", "where")).alias("top")).join(whole.filter("n > 1"), "digest")
    first = written(top.select("digest", F.col("top.page_id").alias("first_page"), F.col("top.rows").alias("first_rows"), F.col("top.where.url").alias("first_url"), F.col("top.where.at").alias("first_at")), "equal-payloads")
    if first.limit(MAX_BROADCAST_DIGESTS + 1).count() <= MAX_BROADCAST_DIGESTS:
        rows = rows.join(F.broadcast(first), "digest", "left")
    else:
        rows = hot_join(rows, first, ["digest"], ["page_id", "url"])

    def packed(batches):
        n = 0
        for batch in batches:
            for i in range(batch.num_rows):
                records = _capture(batch.slice(i, 1).to_pylist()[0])
                if n % MAX_CAPTURES == 0:  # the sink begins a new archive here
                    info = b"software: jobloom\r\nformat: WARC File Format 1.1\r\n"
                    records.insert(0, _member("warcinfo", [("WARC-Record-ID", _urn("warcinfo", records[0])), ("WARC-Date", CAPTURED_AT), ("Content-Type", "application/warc-fields")], info))
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["value"])

    # The row number only tells rows apart within this one projection.
    captures = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(packed, "value binary").select(F.col("value").cast("string"))
    captures.write.option("lineSep", END.decode()).option("compression", "none").option("maxRecordsPerFile", 3 * MAX_CAPTURES + 1).text(path)


def _members(data: bytes) -> Iterator[bytes]:
    """What the gzip members of a file hold, one by one; a file without gzip is one member."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    rest = memoryview(data)
    while rest[:2] == b"\x1f\x8b":
        z, out, at = zlib.decompressobj(31), [], 0
        while not z.eof and at < len(rest):
            out.append(z.decompress(rest[at : at + (1 << 16)]))
            at += 1 << 16
        if not z.eof:
            raise ValueError("a gzip member is cut off")
        yield b"".join(out)
        rest = rest[min(at, len(rest)) - len(z.unused_data) :]


def parse_archive(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(type, headers by lower-case name, block) of each record of an archive, gzipped or not."""
    for member in _members(data):
        at = 0
        while member.startswith(b"WARC/", at):
            end = member.index(b"\r\n\r\n", at)
            headers = {}
            for line in member[at:end].split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                headers[name.strip().lower().decode()] = value.strip().decode()
            length = int(headers["content-length"])
            yield headers["warc-type"], headers, member[end + 4 : end + 4 + length]
            at = end + 4 + length + 4


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``, see ``RECORD``, without ``warcinfo``.
    Payloads are digested where they are read, and returned only if asked for. Without archives
    there are no rows."""

    def parsed(batches):
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for kind, h, block in parse_archive(batch.column("content")[i].as_py()):
                    if kind == "warcinfo":
                        continue
                    payload = block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit", "request") else block
                    fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x) if kind == "metadata" else {}
                    digest = hashlib.sha1(payload).hexdigest() if kind == "response" else h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    page, first = h.get("page-id"), h.get("refers-to-page-id")
                    rows.append((
                        kind, h["warc-record-id"], h.get("warc-concurrent-to"), first, int(page) if page else None, h.get("warc-target-uri"), digest,
                        int(fields["payload-bytes"]) if "payload-bytes" in fields else None, len(payload), page is None, payload if with_payload else None))
                    if len(rows) == 1000 or (with_payload and len(payload) > 1 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(parsed, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response, request, metadata (null where missing).

    Requests name the response or revisit they are concurrent to; metadata records name
    either that or the request. Records that lead to no response are left out; of
    several requests or metadata records of one capture each gives a row.
    """
    whole = F.struct(*[F.col(c.split()[0]) for c in RECORD.split(", ")])
    of = lambda *kinds: records.filter(F.col("type").isin(*kinds)).select("id", "concurrent_to", whole.alias("record"))
    responses = of("response", "revisit").select("id", F.col("record").alias("response"))
    requests = of("request").select(F.col("id").alias("request_id"), F.col("concurrent_to").alias("id"), F.col("record").alias("request"))
    metadata = of("metadata").select(F.col("concurrent_to").alias("to"), F.col("record").alias("metadata"))
    through = requests.select(F.col("request_id").alias("to"), F.col("id").alias("capture"))
    metadata = metadata.join(through, "to", "left").select(F.coalesce("capture", "to").alias("id"), "metadata")
    return responses.join(requests.drop("request_id"), "id", "left").join(metadata, "id", "left").select("response", "request", "metadata")


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = assemble(written(read_records(spark, path).drop("payload").withColumn("payload", F.lit(None).cast("binary")), "warc-records"))
    r = "response."
    return captures.select(
        F.col(r + "page_id").alias("page_id"),
        F.when(F.col(r + "type") == "response", F.col(r + "payload_length")).otherwise(F.col("metadata.payload_bytes")).alias("payload_bytes"),
        F.col(r + "digest").alias("payload_digest"),
        F.col(r + "type").alias("record_type"),
        F.col(r + "refers_to").cast("long").alias("refers_to"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first_page,
    payload_bytes >= 1000 AND count(*) OVER (PARTITION BY payload_digest) > 1 AS many
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN many AND page_id IS DISTINCT FROM first_page AND first_page IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN many AND page_id IS DISTINCT FROM first_page THEN first_page END AS refers_to
FROM f
"""
