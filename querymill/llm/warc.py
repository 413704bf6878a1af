"""Web archives: write WARC records, read them back, merge their indexes into one global order.

Records are written by Spark's text writer with the record separator of the format as line separator, so
archives can lie in any store that Spark reaches. Equal payloads are stored once: later records are revisits.
Every archive gives locally sorted runs of captures; the key space is cut into ranges, and each range
merges its part of all runs with a loser tree, which leaves one order by URL key and time over all ranges.
"""

from __future__ import annotations

import gzip
import hashlib
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.text import broadcast_if_small, staged
from querymill.session import scratch_path

RECORDS, RUN = 2000, 50_000
#: Fixed value: the alphabet of base32.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPTURE = "urlkey string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, place int"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, from pieces of twenty bits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def digested(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html, captured) with payload, payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of at least ``least`` bytes the smallest page_id is the response, the others revisit it; rows that share the
    smallest page_id are all responses, and so are rows with null page_id if no id is known.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "captured", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload.cast("binary")).alias("payload_digest"))
    seen = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("origin"), F.count("*").alias("n"))
    copies = staged(seen.filter("n > 1").select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "origin"), "warc-copies")
    joined = rows.join(broadcast_if_small(copies), (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    later = F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin"))
    return joined.withColumn("record_type", F.when(later, "revisit").otherwise("response")).withColumn("refers_to", F.when(later, F.col("origin"))).drop("d", "b", "origin")


def record() -> Column:
    """The text of one record, without the empty lines that end it. White space in a URL is escaped."""
    end = F.lit("\r\n")
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, end)).otherwise(F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    url = F.col("url")
    for code in (9, 10, 13, 32):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("record_type") == "response", F.concat(http, "payload")).otherwise(http)
    profile = F.when(F.col("record_type") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.col("captured")),
        line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), urn(F.col("refers_to")))), line("WARC-Profile", profile),
        F.lit("Content-Type: application/http;msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")), end, block,
    )


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write pages (page_id, url, html, captured) as gzip-compressed archives of at most RECORDS records below path."""
    rows = digested(pages, least).select(record().alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; lengths, not separators, tell where a block ends."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = stop + 4
        end = begin + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield headers, data[begin:end]
        at = end + 4


def url_key(url: str | None) -> str:
    """Host in reverse order, then path and query; a URL that cannot be read stands for itself."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.lower())
        host = parts.hostname or ""
    except ValueError:
        return url
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){rest}"


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if name in ("", "none") else int(name)


def capture(headers: dict[str, str], block: bytes) -> tuple:
    """One index line. The payload of a response must have the digest that its header gives."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response":
        if len(payload) != size or b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"damaged payload in {headers['warc-record-id']}")
    return (url_key(headers.get("warc-target-uri")), headers.get("warc-date") or "", _page(headers["warc-record-id"]), size, digest, headers["warc-type"], _page(headers.get("warc-refers-to")))


def order_key(row: tuple) -> tuple:
    """URL key, time, page; a missing page comes first."""
    return (row[0], row[1], row[2] is not None, row[2] or 0)


def read_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Archives (path, content) -> captures in sorted runs of at most RUN rows."""
    names = [x.split()[0] for x in CAPTURE.split(", ")]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = [capture(*r) for r in records(gzip.decompress(content))]
            for k in range(0, len(rows), RUN):
                run = sorted(rows[k : k + RUN], key=order_key)
                out = [(*r, f"{path}#{k}", i) for i, r in enumerate(run)]
                yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs: each inner node keeps the loser of its match, so a row costs one match a level."""
    k = len(runs)
    heads, ends = [0] * k, [len(r) for r in runs]
    # a run that is out loses every match
    key = lambda i: (heads[i] == ends[i], order_key(runs[i][heads[i]]) if heads[i] < ends[i] else (), i)
    keys = [key(i) for i in range(k)]
    losers = [-1] * k
    winner = -1
    for i in range(k):
        at, candidate = (i + k) // 2, i
        while at and candidate >= 0:
            if losers[at] < 0:
                losers[at], candidate = candidate, -1
            elif keys[losers[at]] < keys[candidate]:
                losers[at], candidate = candidate, losers[at]
            at //= 2
        if candidate >= 0:
            winner = candidate
    while k and not keys[winner][0]:
        yield runs[winner][heads[winner]]
        heads[winner] += 1
        keys[winner] = key(winner)
        at, candidate = (winner + k) // 2, winner
        while at:
            if keys[losers[at]] < keys[candidate]:
                losers[at], candidate = candidate, losers[at]
            at //= 2
        winner = candidate


def merge_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one range, run by run, into the order of order_key."""
    runs: dict[str, list[tuple]] = {}
    names: list[str] = []
    for pdf in batches:
        names = list(pdf.columns)
        plain = pdf.astype(object).where(pdf.notna(), None)
        for row in plain.itertuples(index=False, name=None):
            runs.setdefault(row[7], []).append(row)
    out = []
    for row in loser_tree(list(runs.values())):
        out.append(row)
        if len(out) == RUN:
            yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
            out = []
    if out:
        yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def capture_index(spark, path: str) -> DataFrame:
    """Captures of all archives below path in global order: partitions hold rising ranges, rows rise inside them.

    The ranges are cut on URL key, time and page, so a URL with many captures spreads over several. An empty folder gives no rows.
    """
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = staged(archives.mapInPandas(read_runs, CAPTURE), "runs")
    ranges = runs.repartitionByRange("urlkey", "captured", "page_id").sortWithinPartitions("run", "place")
    return ranges.mapInPandas(merge_runs, CAPTURE)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages (page_id, url, html, captured) as archives in the shared folder and return the index read back from them."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, least)
    return capture_index(spark, path)
