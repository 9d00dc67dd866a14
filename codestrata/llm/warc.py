"""Deduplicated WARC archives of pages: payloads that occur more than once are kept once, and the other records revisit them.

``archive`` shuffles narrow headers by payload digest to choose each payload's response, drops copies of a payload before it is
shuffled, joins the revisits to the chosen responses and writes WARC 1.1 files with fresh headers.  ``read`` gives the records of
such a folder, and ``resolve`` joins revisits to their responses by record id, so that every record has its full payload's figures.

Files are written and read by Spark's text source, hence on any store that Spark reaches: one gzip stream a file.  Each record
begins with the version line and a header that holds a random boundary drawn per archive, so records are told apart without
searching payloads for markers; the block's length is checked against ``Content-Length``.

Payloads are the UTF-8 bytes of ``html``; a null one is empty.  A null ``page_id`` counts as the smallest and leaves its header
out, as does a null ``url``; line ends and blanks in a url are written as percent signs and digits.  Rows that repeat a page id
are records of their own: of rows with the largest id and url one is the response, the others revisit it.  Other columns than
``page_id``, ``url`` and ``html`` are not read; an empty table gives no record.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_BYTES = 1000  # of a payload that others may revisit
REPEATS = 4096  # equal rows that one row stands for while they are multiplied

# Fixed values of the format (WARC 1.1).
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BOUNDARY = "X-Archive-Boundary"
PAGE_ID = "X-Page-Id"


def urn(digest: Column) -> Column:
    """Record id made of the first 32 hexadecimal digits."""
    shape = "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$"
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, shape, "$1-$2-$3-$4-$5"), F.lit(">"))


def header(name: str, value: Column) -> Column:
    """A header line, or null for a null value."""
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def uri(url: Column) -> Column:
    for char, written in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("\t", "%09")):
        url = F.replace(url, F.lit(char), F.lit(written))
    return url


def record(kind: str, boundary: str, date: str, record_id: Column, payload: Column, payload_bytes: Column, sha1: Column, refers: list[Column]) -> Column:
    """Text of a record up to the last line feed, which the text writer adds."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), payload_bytes.cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, payload)
    lines = [
        F.lit(VERSION),
        F.lit(f"{BOUNDARY}: {boundary}"),
        header("WARC-Type", F.lit(kind)),
        header("WARC-Record-ID", record_id),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", uri(F.col("url"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        header(PAGE_ID, F.col("page_id")),
        *refers,
        F.lit("Content-Type: application/http; msgtype=response"),
        header("Content-Length", F.octet_length(http) + F.octet_length(payload)),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block, F.lit("\r\n\r")).alias("value")


def archive(pages: DataFrame, folder: str | None = None, date: str | None = None) -> str:
    """Write one record per page and return the folder of the files, by default a new one in the shared folder.

    Records whose payload has fewer than ``LEAST_BYTES`` bytes are responses.  Of the others with one payload, that of the
    largest (page_id, url) is the response; payloads are equal when their SHA-256 is.
    """
    spark = pages.sparkSession
    folder = folder or f"{common.shared_folder(spark)}/llm/warc-{uuid.uuid4().hex}"
    boundary, date = uuid.uuid4().hex, date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], F.coalesce(pages["html"], F.lit("")).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long"))
    long, short = F.col("bytes") >= LEAST_BYTES, F.col("bytes") < LEAST_BYTES
    page = F.struct("page_id", "url")

    heads = rows.where(long).select("page_id", "url", "bytes", F.sha2("html", 256).alias("key"), F.sha1("html").alias("sha1"))
    heads = heads.groupBy("key", "sha1", "bytes", "page_id", "url").agg(F.count(F.lit(1)).alias("times"))
    heads = common.staged(heads, "warc-heads")
    chosen = heads.groupBy("key").agg(F.max(page).alias("chosen"), F.sum("times").alias("rows")).where("rows > 1").select("key", "chosen")
    again = F.col("times") - F.when(page.eqNullSafe(F.col("chosen")), 1).otherwise(0)
    revisits = heads.join(chosen, "key").withColumn("again", again).where("again > 0")
    # Equal rows come out one by one; blocks of them first, so that no array grows with their number.
    revisits = revisits.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(again - 1) div {REPEATS}"))))
    revisits = revisits.withColumn("nth", F.explode(F.sequence(F.lit(1), F.least(F.lit(REPEATS), F.col("again") - F.col("block") * REPEATS).cast("int"))))
    refers = [
        header("WARC-Profile", F.lit(PROFILE)),
        header("WARC-Refers-To", urn(F.col("key"))),
        header("WARC-Refers-To-Target-URI", uri(F.col("chosen.url"))),
        header("WARC-Refers-To-Date", F.lit(date)),
    ]
    fresh = urn(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")))
    revisited = revisits.select(record("revisit", boundary, date, fresh, F.lit(""), F.col("bytes"), F.col("sha1"), refers))

    # Copies of a payload fall together before the shuffle, whatever their number.
    kept = rows.where(long).groupBy(F.sha2("html", 256).alias("key")).agg(F.max(page).alias("page"), F.first("html").alias("html"))
    kept = kept.select("key", "page.page_id", "page.url", "html")
    first = kept.select(record("response", boundary, date, urn(F.col("key")), F.col("html"), F.octet_length("html"), F.sha1("html"), []))
    small = rows.where(short).select(record("response", boundary, date, fresh, F.col("html"), F.col("bytes"), F.sha1("html"), []))
    first.unionAll(revisited).unionAll(small).write.option("lineSep", "\n").option("compression", "gzip").text(folder)
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of an archive: record_id, record_type, page_id, url, refers_to_id, block, payload_digest (as in the header)."""
    start = [row["value"] for row in spark.read.option("lineSep", "\n").text(folder).limit(2).collect()]
    if start:
        mark = start[1].rstrip("\r") if len(start) > 1 else ""
        if not mark.startswith(f"{BOUNDARY}: "):
            raise ValueError(f"not an archive written by archive(): {folder}")
        mark = f"{VERSION}\r\n{mark}\r\n"
    else:
        mark = VERSION
    rows = spark.read.option("lineSep", mark).text(folder).where("value <> ''")
    rows = rows.withColumn("head", F.substring_index("value", "\r\n\r\n", 1))
    rows = rows.withColumn("names", F.str_to_map("head", F.lit("\r\n"), F.lit(": ")))
    rows = rows.withColumn("block", F.expr("substring(value, length(head) + 5, length(value) - length(head) - 8)"))
    told = F.col("names")["Content-Length"].cast("long")
    block = F.when(F.octet_length("block") == told, F.col("block")).otherwise(F.raise_error(F.lit("a record's block has another length than its header tells")))
    return rows.select(
        F.col("names")["WARC-Record-ID"].alias("record_id"),
        F.col("names")["WARC-Type"].alias("record_type"),
        F.col("names")[PAGE_ID].cast("long").alias("page_id"),
        F.col("names")["WARC-Target-URI"].alias("url"),
        F.col("names")["WARC-Refers-To"].alias("refers_to_id"),
        F.replace(F.col("names")["WARC-Payload-Digest"], F.lit("sha1:"), F.lit("")).alias("payload_digest"),
        block.alias("block"),
    )


def payload(block: Column) -> Column:
    """What follows the HTTP header of a block."""
    return F.substring(block, F.instr(block, "\r\n\r\n") + 4, F.length(block))


def resolve(records: DataFrame) -> DataFrame:
    """Each record with its full payload's figures: a revisit takes them, and refers_to, from the response it refers to.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to.  Figures come from the payloads read, not from
    headers; a payload that differs from its header's digest, or a revisit whose response is missing, is an error.
    """
    full = payload(F.col("block"))
    sha1 = F.when(F.col("record_type") == "response", F.sha1(full))
    same = F.when(sha1 == F.col("payload_digest"), sha1).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    narrow = records.select(
        "record_id", "record_type", "page_id", "refers_to_id", F.col("payload_digest").alias("told"),
        F.when(F.col("record_type") == "response", same).alias("digest"),
        F.when(F.col("record_type") == "response", F.octet_length(full).cast("long")).alias("bytes"),
    )
    narrow = common.staged(narrow, "warc-read")
    responses = narrow.where("record_type = 'response'")
    targets = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("digest").alias("payload_digest"), F.col("bytes").alias("payload_bytes"))
    found = narrow.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to_id", "told").join(targets, "refers_to_id", "left")
    digest = F.when(F.col("told") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a revisit's response is missing")))
    found = found.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
    own = responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(found)
