"""Resolving not-modified revisit records of web archives by an as-of join.

A revisit record has no payload. By canonical URL it belongs to the latest full response captured
before it; if the validators agree, the response's headers, with those the revisit may renew, and the
response's payload stand for it. Only headers and ids are shuffled, never payloads.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm import common

#: Query parameters that do not name another page.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"
#: Headers that describe a stored body or a single connection: a not-modified answer never renews them.
NOT_RENEWED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "te", "trailer", "transfer-encoding", "upgrade")
RECORD = "record_id string, type string, uri string, captured long, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Host without www and path: no scheme, port, fragment, tracking parameter, final slash or .html; null stays null."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, rf"(?i)([?&]){TRACKING}=[^&]*(?=&|$)", "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"&{2,}", "&"), r"\?&+", "?")
    u = F.regexp_replace(u, r"[?&]+$", "")
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    return F.concat(host, F.regexp_replace(F.regexp_replace(path, r"\.html(?=\?|$)", ""), r"/(?=\?|$)", ""))


def lowered(headers: Column) -> Column:
    """Header names in lower case; of names that repeat the last counts, as in the map given."""
    return F.aggregate(
        F.map_entries(F.coalesce(headers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))),
        F.expr("cast(map() as map<string,string>)"),
        lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])),
    )


def merged(stored: Column, renewed: Column) -> Column:
    """Headers of a response after a not-modified answer."""
    allowed = F.map_filter(renewed, lambda k, v: ~k.isin(*NOT_RENEWED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def resolved(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """Each revisit of records (record_id, type, uri, captured, headers) with what it stands for:
    record_id, url, response_id, status, headers.

    The response is the latest with ``captured`` before the revisit's, of equal times the largest id.
    status: resolved; changed if an etag, or without etags a last-modified, is on both and differs;
    unchecked if there is none on both; missing without a response, with the revisit's own headers and
    a response_id of null. Records without a URL or time match nothing. Rows that repeat are answered each;
    an empty table gives no rows.

    Records are dealt into ranges of (url, captured) with equal numbers of rows, however many captures a
    URL has and however close they are; a range knows the last response of the ranges before it.
    """
    at = records.select("record_id", F.lower("type").alias("type"), canonical_url(F.col("uri")).alias("url"), F.col("captured").cast("long").alias("captured"), lowered(F.col("headers")).alias("headers"))
    at = at.where(F.col("type").isin("response", "revisit"))
    complete = F.col("url").isNotNull() & F.col("captured").isNotNull()
    alone = at.where(~complete & (F.col("type") == "revisit")).select("record_id", "url", "captured", "headers")
    # of one time, revisits come first: only an earlier response counts
    order = ["captured", F.col("type").desc(), "record_id"]
    dealt = at.where(complete)
    dealt = dealt.repartitionByRange(*[partitions] * (partitions is not None), F.col("url"), F.col("captured"), F.col("type").desc(), F.col("record_id"))
    at = common.written(dealt.withColumn("range", F.spark_partition_id()), "records")
    answer = F.struct("captured", F.col("record_id").alias("id"), "headers")
    last = at.where("type = 'response'").groupBy("url", "range").agg(F.max_by(answer, F.struct("captured", "record_id")).alias("last"))
    # one row for each URL and range that has it
    earlier = Window.partitionBy("url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = at.select("url", "range").distinct().join(last, ["url", "range"], "left")
    ends = ends.withColumn("before", F.last("last", ignorenulls=True).over(earlier)).select("url", "range", "before").where("before is not null").hint("merge")
    within = Window.partitionBy("url", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = at.withColumn("here", F.last(F.when(F.col("type") == "response", answer), ignorenulls=True).over(within)).where("type = 'revisit'")
    out = seen.join(ends, ["url", "range"], "left").select("record_id", "url", "captured", "headers", F.coalesce("here", "before").alias("of"))
    out = out.unionByName(alone.withColumn("of", F.lit(None).cast(out.schema["of"].dataType)))

    def validator(name: str) -> tuple[Column, Column]:
        return F.col("headers")[name], F.col("of.headers")[name]

    (etag, of_etag), (date, of_date) = validator("etag"), validator("last-modified")
    agree = F.when(etag.isNotNull() & of_etag.isNotNull(), F.regexp_replace(etag, "^W/", "") == F.regexp_replace(of_etag, "^W/", "")).when(date.isNotNull() & of_date.isNotNull(), date == of_date)
    status = F.when(F.col("of").isNull(), "missing").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("changed")
    headers = F.when(status.isin("resolved", "unchecked"), merged(F.col("of.headers"), F.col("headers"))).otherwise(F.col("headers"))
    return out.select("record_id", "url", F.col("of.id").alias("response_id"), status.alias("status"), headers.alias("headers"))


def with_payloads(answers: DataFrame, records: DataFrame) -> DataFrame:
    """The answered revisits with their response's payload, joined by record id."""
    body = records.where(F.lower("type") == "response").select(F.col("record_id").alias("response_id"), "payload")
    ok = F.col("status").isin("resolved", "unchecked")
    return answers.withColumn("response_id", F.when(ok, F.col("response_id"))).join(body, "response_id", "left")


def _microseconds(when: str | None) -> int | None:
    from datetime import datetime, timezone

    try:
        at = datetime.fromisoformat(when.replace("Z", "+00:00"))
    except (AttributeError, ValueError):
        return None
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1_000_000)


def parse(content: bytes | BinaryIO) -> Iterator[tuple]:
    """Records of a WARC file or stream, plain or gzip, as (record_id, type, uri, captured, headers, payload).

    A date that is none gives a time of null. A record without a length in digits has no known end: it is
    left out, and reading goes on at the next line that begins a record. A record that the file ends within is
    left out, too. What follows a damage of the compression is lost; what came before it is not. No more than a
    record is held at a time.
    """
    raw = io.BufferedReader(io.BytesIO(content) if isinstance(content, bytes) else content, 1 << 20)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.peek(2)[:2] == b"\x1f\x8b" else raw

    def fields() -> dict[str, str]:
        out: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            out[name.strip().lower()] = value.strip()
        return out

    try:
        while (line := stream.readline()):
            if not line.startswith(b"WARC/"):
                continue
            warc = fields()
            length = warc.get("content-length", "")
            if not (length.isascii() and length.isdigit()):
                continue
            body = stream.read(int(length))
            if len(body) < int(length):
                return
            head, gap, payload = body.partition(b"\r\n\r\n")
            http = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])} if gap else {}
            yield warc.get("warc-record-id"), warc.get("warc-type"), warc.get("warc-target-uri"), _microseconds(warc.get("warc-date")), list(http.items()), payload if gap else body
    except (EOFError, OSError, zlib.error):
        return


def opened(path: str) -> BinaryIO:
    """A stream of the bytes of a file by its path or URI."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return open("/" + rest.lstrip("/") if colon else path, "rb")
    host, _, inner = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{host}/")
    return system.open_input_stream(f"{base.rstrip('/')}/{inner}")


def read(spark: SparkSession, path: str, opener: Callable[[str], BinaryIO] = opened) -> DataFrame:
    """Records of all WARC files under a path, a large file a task.

    Spark lists the files and deals them out by their size; a task opens its files as streams by ``opener``, so that
    a file, of whatever size, is never one value. Records leave in batches of at most some 16 MB, or of one record.
    A file that is gone or may not be read fails the job; one without records gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [f.split()[0] for f in RECORD.split(", ")]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with opener(name) as stream:
                    for row in parse(stream):
                        rows.append(row)
                        size += len(row[-1])
                        if len(rows) == 256 or size > 16 << 20:
                            yield table(rows)
                            rows, size = [], 0
                if rows:
                    yield table(rows)

    # without the content: the source then lists files and reads none
    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, RECORD)


def crawl_log(pages: DataFrame) -> DataFrame:
    """A crawl log of a table of pages, without payloads: each page as a response captured at twice its id,
    and a conditional request for it half the table later that the server answers with not modified.
    Of ten pages seven have an etag, two a last-modified alone and one no validator."""
    n = pages.agg(F.count("*").alias("n"))
    at = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.length(F.coalesce("html", F.lit(""))).alias("size"))
    at = at.join(F.broadcast(n))  # one row
    kind = F.col("page_id") % 10
    etag, changed = F.when(kind > 2, F.col("digest")), F.when(kind.isin(1, 2), F.concat(F.lit("m"), F.left("digest", F.lit(1))))

    def headers(etag: Column, size: Column, date: Column) -> Column:
        every = F.create_map(F.lit("ETag"), etag, F.lit("Last-Modified"), changed, F.lit("Content-Length"), size.cast("string"), F.lit("Date"), date.cast("string"))
        return F.map_filter(every, lambda k, v: v.isNotNull())

    both = F.array(
        F.struct(F.col("page_id").alias("record_id"), F.lit("response").alias("type"), F.col("url").alias("uri"), (2 * F.col("page_id")).alias("captured"), headers(etag, F.col("size"), F.col("page_id")).alias("headers")),
        F.struct(F.col("page_id").alias("record_id"), F.lit("revisit").alias("type"), F.col("url").alias("uri"), (2 * F.col("page_id") + F.col("n") + 1 - F.col("n") % 2).alias("captured"), headers(F.concat(F.lit("W/"), etag), F.lit(0), F.col("page_id") + F.col("n")).alias("headers")),
    )
    return at.select(F.inline(both))
