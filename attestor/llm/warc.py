"""WARC archives with revisit resolution.

Headers (page, digest, length) are shuffled by payload digest to elect one response per payload;
revisit records are joined to it and written without the payload. The archives are plain WARC
1.1 files, written by Spark's own writer, so that any file system will do, and read back record
by record by their Content-Length.
"""

from __future__ import annotations

import gzip
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import mapped, prepared, stored
from attestor.session import scratch_folder

LEAST_BYTES = 1000
FILE_BYTES, MOST_BYTES = 16 << 20, 1 << 30

# fixed values of the format
VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def resolved(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, digest, n, refers_to): refers_to is null for responses.

    Of pages with equal payloads of at least ``least_bytes`` the largest page_id is the response.
    Rows that share page_id and payload have the same type, so a repeated response is a response
    again. A null html is the empty payload; a null page_id ranks below all others, and pages
    with equal payloads and no page_id at all are responses.
    """
    plain = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce("html", F.lit("")).alias("html"))
    full = plain.withColumns({"digest": F.sha1("html"), "n": F.octet_length("html").cast("bigint")})
    headers = full.filter(F.col("n") >= least_bytes).select("page_id", "digest")
    elected = (headers.groupBy("digest").agg(F.max("page_id").alias("response"), F.min(F.coalesce("page_id", F.lit(-(1 << 63)))).alias("least"))
               .filter("least <> response").select("digest", "response"))
    revisits = (headers.join(elected, "digest").filter("NOT page_id <=> response")
                .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("response").alias("refers_to")).distinct())
    return (full.join(revisits, F.expr("page_id <=> _page AND digest = _digest"), "left")
            .select("page_id", "url", "html", "digest", "n", "refers_to"))


def _record_id(page: Column, digest: Column) -> Column:
    """A name-based URN: the same page and payload always have the same."""
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), digest))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """(record): resolved pages as the text of one WARC record each, without the closing empty lines."""
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    lines = F.concat_ws(
        "\r\n", F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"), F.col("digest")))),
        F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return pages.select(F.concat(lines, F.lit("\r\n\r\n"), block).alias("record"))


def records_per_file(pages: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """How many records make an archive of about ``file_bytes``, and none that cannot be read in one piece."""
    size = F.octet_length("html") + 600
    mean, most = pages.agg(F.avg(size), F.max(size)).first()
    return max(1, int(min(file_bytes / (mean or 600), MOST_BYTES / (most or 600))))


def write(pages: DataFrame, path: str, per_file: int) -> str:
    """Write resolved pages as gzip archives of at most ``per_file`` records and return the folder.

    The text writer puts the two closing line ends of the format after each record. Pages go from
    the join with their revisit headers straight into files.
    """
    (records(pages).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))
    return path


def parse(data: bytes):
    """(headers, block) of each record of an archive; the Content-Length says where a block ends."""
    at = 0
    while at < len(data):
        top = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:top].decode("utf-8", "replace").split("\r\n")
        if version != VERSION:
            raise ValueError(f"no record at byte {at}: {version[:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        end = top + 4 + int(headers["Content-Length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield headers, data[top + 4:end]
        at = end + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, page_id, url, digest, refers_to_id, payload), one row per record.

    The digest of a response is computed from the payload as read, that of a revisit is the one
    in its header. A revisit has no payload.
    """
    def work(rows):
        for (content,) in rows:
            for h, block in parse(gzip.decompress(content)):
                payload = block.partition(b"\r\n\r\n")[2]
                kind = h["WARC-Type"]
                digest = hashlib.sha1(payload).hexdigest() if kind == "response" else h["WARC-Payload-Digest"][5:]
                yield (h["WARC-Record-ID"], kind, int(h["X-Page-Id"]) if "X-Page-Id" in h else None, h.get("WARC-Target-URI"),
                       digest, h.get("WARC-Refers-To"), payload if kind == "response" else None)

    files = spark.read.format("binaryFile").load(path).select("content")
    return mapped(files, work, "record_id string, record_type string, page_id bigint, url string, digest string, "
                               "refers_to_id string, payload binary")


def digest(pages: DataFrame) -> DataFrame:
    """Write the pages to archives, read these back and say of each page what its record is."""
    spark = prepared(pages.sparkSession)
    path = write(resolved(pages), scratch_folder(spark, "llm-warc"), records_per_file(pages))
    found = stored(read(spark, path).select("record_id", "record_type", "page_id", "digest", "refers_to_id",
                                     F.octet_length("payload").cast("bigint").alias("n")), "warc-found")
    revisits, responses = found.filter("record_type = 'revisit'"), found.filter("record_type = 'response'")
    originals = (responses.groupBy(F.col("record_id").alias("refers_to_id"))
                 .agg(F.first("page_id").alias("refers_to"), F.first("n").alias("n")))
    resolved_again = revisits.drop("n").join(originals, "refers_to_id", "left")
    return (responses.withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(resolved_again)
            .select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                    "record_type", "refers_to"))
