"""WARC archives: write captures, read them back, assemble transactions.

Writing: every page becomes three records - request, response (or revisit) and
metadata - where request and metadata name the response in ``WARC-Concurrent-To``.
Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the
smallest id carries the payload; the others are ``revisit`` records that name it in
``WARC-Refers-To`` (by record id; its page in ``X-Refers-To-Page``) and keep the payload's
digest and length.  Records are UTF-8, so
Spark's text writer emits them as they are (record separator as line separator,
gzip): the commit protocol, retries and any file system Spark knows come with it.

Reading: each archive file is one row of bytes, decompressed piece by piece - plain,
one gzip member, or one member per record, as other writers make them; its records
are framed by ``Content-Length`` alone, so payloads may hold blank lines or whole
records.  Header names are read in any case, with or without a space after the colon, and
may come repeatedly (``concurrent`` lists all ``WARC-Concurrent-To``).  A task holds the
compressed file and one record.

Assembly: request, response and metadata meet on the id that ``WARC-Concurrent-To``
names; since every record knows its capture, one aggregation by that id is the
three-way join in a single shuffle.

Cases: null html is an empty payload; repeated rows are captures of their own (if
they carry the smallest id of their payload, all are responses); null ids are kept
and come back null (a null id is never the smallest unless all are null, in which
case all are responses); empty tables give empty archives and results; columns
beyond id, url and html are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import shared_dir, table, text_of

MIN_REVISIT = 100
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
AGENT = "tidepool"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    return F.concat(
        F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">")
    )


def _record(kind: Column | str, record_id: Column, headers: list[tuple[str, Column]], body: Column, body_type: str) -> Column:
    """One record without its closing separator; headers with a null value are left out."""
    head = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(DATE)), *headers,
            ("Content-Type", F.lit(body_type)), ("Content-Length", F.octet_length(body).cast("string"))]
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("", *[F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in head]), F.lit("\r\n"), body)


def capture_plan(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Rows (id, row, url, html, digest, n_bytes, refers_to, refers_row); html travels once, by id."""
    html = text_of(html_col)
    rows = pages.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(url_col).alias("url"), html.alias("html"))
    marks = rows.select("id", "row", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n")).filter(f"n >= {MIN_REVISIT}")
    first = marks.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("digest", "first")
    # several rows may carry the smallest id: revisits name the first of them
    rows_of_first = marks.join(first.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("id") == F.col("first")))
    first = rows_of_first.groupBy("digest", "first").agg(F.min("row").alias("first_row"))
    # the few columns of marks meet on the digest; html meets the outcome on the id, which no payload makes hot
    later = marks.join(first, "digest").filter("id > first").select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "first", "first_row").distinct()
    known = rows.withColumn("digest", F.sha2("html", 256)).withColumn("n_bytes", F.octet_length("html").cast("long"))
    return known.join(later, (F.col("id") == F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left").select(
        "id", "row", "url", "html", "digest", "n_bytes", F.col("first").alias("refers_to"), F.col("first_row").alias("refers_row")
    )


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write ``pages`` as gzip-compressed WARC files below ``path``."""
    plan = capture_plan(pages, id_col, url_col, html_col)
    key = [F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("row").cast("string")]
    referred = _uuid(F.lit("response"), F.col("refers_to").cast("string"), F.col("refers_row").cast("string"))
    own, request, meta = (_uuid(F.lit(k), *key) for k in ("response", "request", "metadata"))
    # a header value is one line: line ends in it become percent codes
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    target = [("WARC-Target-URI", uri)]
    again = F.col("refers_to").isNotNull()
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    response = _record(
        F.when(again, "revisit").otherwise("response"), own,
        [*target, ("X-Page-Id", F.col("id").cast("string")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
         ("X-Payload-Length", F.col("n_bytes").cast("string")), ("WARC-Profile", F.when(again, PROFILE)),
         ("WARC-Refers-To", F.when(again, referred)), ("X-Refers-To-Page", F.col("refers_to").cast("string"))],
        F.when(again, http).otherwise(F.concat(http, F.col("html"))), "application/http; msgtype=response",
    )
    get = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("")), F.lit(f" HTTP/1.1\r\nUser-Agent: {AGENT}\r\n\r\n"))
    records = F.array(
        _record("request", request, [*target, ("WARC-Concurrent-To", own)], get, "application/http; msgtype=request"),
        response,
        _record("metadata", meta, [*target, ("WARC-Concurrent-To", own)], F.concat(F.lit("payload-bytes: "), F.col("n_bytes").cast("string"), F.lit("\r\n")), "application/warc-fields"),
    )
    plan.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


RECORD = "type string, record_id string, concurrent_to string, uri string, page_id long, digest string, n_bytes long, refers_to string, body binary, checked boolean, concurrent array<string>, refers_to_record string"


FEED = 1 << 16  # compressed bytes that are looked at together
STEP = 1 << 20  # bytes that are decompressed at a time


def inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of a WARC file: plain, or gzip with any number of members, one per record as a rule."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            if at == len(view):
                raise ValueError("the archive ends within a gzip member")
            feed: bytes | memoryview = view[at : at + FEED]
            at += len(feed)
            while len(feed) and not member.eof:
                yield member.decompress(feed, STEP)
                feed = member.unconsumed_tail
        at -= len(member.unused_data)
        while at < len(view) and view[at] == 0:  # padding between members
            at += 1


def headers_of(head: bytes) -> dict[str, list[str]]:
    """Values by lower-cased name, in order; a line that starts with white space goes on with the one before."""
    out: dict[str, list[str]] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last][-1] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out.setdefault(last, []).append(value.strip())
    return out


def parse_records(data: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers, block) of each record, framed by Content-Length; holds one record and a piece."""
    pieces = iter([data]) if isinstance(data, bytes) else data
    held, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]
        held.extend(piece)
        at = 0
        return True

    while True:
        while len(held) - at < 5 and more():
            pass
        if at == len(held):
            return
        if not held.startswith(b"WARC/", at):
            raise ValueError(f"no record where one should start: {bytes(held[at : at + 20])!r}")
        seen = 0
        while (stop := held.find(b"\r\n\r\n", at + seen)) < 0:
            seen = max(0, len(held) - at - 3)  # found pieces aren't searched again
            if not more():
                raise ValueError("a record is cut off in its headers")
        headers = headers_of(bytes(held[held.index(b"\r\n", at) + 2 : stop]))
        n = int(headers["content-length"][0])
        start = stop + 4 - at
        while len(held) - at < start + n + 4 and more():
            pass
        if held[at + start + n : at + start + n + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield headers, bytes(held[at + start : at + start + n])
        at += start + n + 4


def _reader(with_body: bool):
    def read(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for chunk in files:
            for data in chunk["content"]:
                rows, held = [], 0
                for h, block in parse_records(inflated(data)) if data else ():
                    one = lambda name, h=h: h.get(name, [None])[0]
                    kind, checked = one("warc-type"), None
                    body = block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit") else block
                    digest, n = (one("warc-payload-digest") or "").removeprefix("sha256:") or None, one("x-payload-length")
                    if kind == "response":  # digest and length of what was read, not of what the header says
                        read_digest = hashlib.sha256(body).hexdigest()
                        digest, n, checked = read_digest, len(body), read_digest == digest
                    page, refers = one("x-page-id"), one("x-refers-to-page")
                    rows.append((
                        kind, one("warc-record-id"), one("warc-concurrent-to"), one("warc-target-uri"), int(page) if page else None, digest,
                        int(n) if n is not None else None, refers, body if with_body else None, checked, h.get("warc-concurrent-to", []), one("warc-refers-to"),
                    ))
                    held += len(body) * with_body
                    if len(rows) >= 5000 or held > 8 << 20:
                        yield _frame(rows)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows)

    return read


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "n_bytes": "Int64"})


def read_records(spark: SparkSession, path: str, with_body: bool = True) -> DataFrame:
    """All records of the archives below ``path``, one row each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(_reader(with_body), RECORD)


def assembled(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture, request, response, metadata)."""
    part = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), F.struct(*[c for c in records.columns if c != "concurrent_to"])), ignorenulls=True)
    return (
        records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture"))
        .agg(part("request").alias("request"), part("response", "revisit").alias("response"), part("metadata").alias("metadata"))
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    r = F.col("response")
    # without the blocks: payloads are hashed where they are read, and don't travel again
    return assembled(read_records(spark, path, with_body=False).drop("body")).select(
        r["page_id"].alias("page_id"), r["n_bytes"].alias("payload_bytes"), r["digest"].alias("payload_digest"),
        r["type"].alias("record_type"), r["refers_to"].cast("long").alias("refers_to"), F.col("request")["uri"].alias("url"),
    )


OP8_SQL = """
with p as (select page_id, coalesce(url, null) as url, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first_id from p where n >= 100 group by d)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
  case when f.first_id < p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first_id < p.page_id then f.first_id end as refers_to, p.url
from p left join f on p.d = f.d and p.n >= 100
"""
