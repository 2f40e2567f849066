"""WARC writing with revisit resolution, and reading back.

Headers (id, digest, length) are grouped by payload digest, which finds the original of
every payload; a copy becomes a ``revisit`` record that names it. Only originals carry
their payload into the archive. Headers alone are shuffled for the decision, pages once
for the archive, and copies travel without their payload.

An archive is written with Spark's text writer (one record a row, the record end as line
separator), so files are committed by Spark and work on any file system it can write.
Reading parses each file by ``Content-Length``, so payloads may hold anything.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.session import scratch_path

MIN_REVISIT_BYTES = 100
#: Records in one archive file at most; bounds what a reader holds in memory.
RECORDS_PER_FILE = 2_000
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def payload_headers(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest) of every page; a null payload is empty."""
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.octet_length(body).cast("long").alias("payload_bytes"),
                        F.sha2(body, 256).alias("payload_digest"))


def resolve_revisits(headers: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add record_type and refers_to to (page_id, payload_bytes, payload_digest) headers.

    Of equal payloads of at least ``min_bytes`` the smallest page_id is the response (of
    repeated rows with that id all are); the others, and rows with a null id beside one that
    has an id, revisit it. Shorter payloads are all responses. The minimum is aggregated
    before the shuffle; only payloads that occur more than once are joined back.
    """
    big = headers.where(F.col("payload_bytes") >= min_bytes)
    first = big.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("__n"))
    first = first.where((F.col("__n") > 1) & F.col("first_id").isNotNull()).drop("__n")
    out = headers.join(first, "payload_digest", "left")
    copy = (F.col("payload_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return out.select("page_id", "payload_bytes", "payload_digest",
                      F.when(copy, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
                      F.when(copy, F.col("first_id")).alias("refers_to"))


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")))


def warc_records(pages: DataFrame, decisions: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html", date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: the text of one record per page, without its end mark.

    A decision is taken up by (page id, digest), so repeated ids with different payloads keep
    their own. Equal rows are written as often as they occur.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("__url"), body.alias("__body"),
                        F.sha2(body.cast("binary"), 256).alias("payload_digest"))
    copies = decisions.where(F.col("record_type") == "revisit").select("page_id", "payload_digest", "refers_to").distinct()
    page = page.withColumn("__id", F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).join(
        copies.select(F.coalesce(F.col("page_id").cast("string"), F.lit("none")).alias("__id"), "payload_digest", "refers_to"),
        ["__id", "payload_digest"], "left")
    size = F.octet_length(F.col("__body").cast("binary")).cast("string")
    http = F.concat(F.lit(_HTTP), size, F.lit("\r\n\r\n"))
    is_copy = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.coalesce(F.col("__url"), F.lit("")), r"[\x00-\x20]", "%20")
    block = F.when(is_copy, http).otherwise(F.concat(http, F.col("__body")))
    head = [F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_copy, F.lit("revisit")).otherwise(F.lit("response")),
            F.lit("\r\nWARC-Record-ID: <"), _uri(F.col("page_id")), F.lit(">\r\nWARC-Date: " + date + "\r\nWARC-Target-URI: "), url,
            F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
            F.when(is_copy, F.concat(F.lit("\r\nWARC-Profile: " + PROFILE + "\r\nWARC-Refers-To: <"), _uri(F.col("refers_to")), F.lit(">"))).otherwise(F.lit("")),
            F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
            F.octet_length(block.cast("binary")).cast("string"), F.lit("\r\n\r\n"), block]
    return page.select(F.concat(*head).alias("value"))


def write_warc(records: DataFrame, path: str, *, records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip") -> str:
    """Write record texts as WARC files under ``path``; compression: ``gzip`` or ``none``."""
    records.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)
    return path


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers with lower-cased names, block) of every record of one archive file, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
        begin = end + 4
        size = int(head["content-length"])
        yield head, data[begin: begin + size]
        at = begin + size + len(RECORD_END)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``: page_id, record_type, refers_to, url,
    payload_digest (as the header says), payload_bytes and read_digest (of the payload as
    read; null for a revisit, which has none)."""
    def number(uri: str | None):
        text = (uri or "").strip("<>").rpartition(":")[2]
        return int(text) if text.lstrip("-").isdigit() else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                rows = []
                for head, block in parse_warc(content):
                    payload = block[block.index(b"\r\n\r\n") + 4:]
                    revisit = head["warc-type"] == "revisit"
                    rows.append((number(head["warc-record-id"]), head["warc-type"], number(head.get("warc-refers-to")),
                                 head.get("warc-target-uri"), head["warc-payload-digest"].removeprefix("sha256:"),
                                 None if revisit else len(payload), None if revisit else hashlib.sha256(payload).hexdigest()))
                cols = ["page_id", "record_type", "refers_to", "url", "payload_digest", "payload_bytes", "read_digest"]
                out = pd.DataFrame(rows, columns=cols)
                for c in ("page_id", "refers_to", "payload_bytes"):
                    out[c] = out[c].astype("Int64")
                yield out

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(read, "page_id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long, read_digest string")


def resolve_archive(records: DataFrame) -> DataFrame:
    """Give every revisit record of ``read_warc`` the length and digest of its original.

    The join meets one row for each original that has copies, by its id and digest. Records
    whose payload does not have the digest of their header fail the job.
    """
    sound = F.when(F.col("read_digest") == F.col("payload_digest"), F.col("read_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest in record "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))))
    own = records.where(F.col("record_type") == "response").select("page_id", "payload_bytes", sound.alias("payload_digest"),
                                                                   "record_type", F.lit(None).cast("long").alias("refers_to"))
    copies = records.where(F.col("record_type") == "revisit")
    wanted = copies.groupBy(F.col("refers_to").alias("__id"), F.col("payload_digest").alias("__dg")).count().drop("count")
    first = own.join(wanted, (F.col("page_id") == F.col("__id")) & (F.col("payload_digest") == F.col("__dg")), "left_semi").groupBy(
        F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("__bytes"))
    seen = copies.drop("payload_bytes").join(first, ["refers_to", "payload_digest"], "left")
    return own.unionByName(seen.select("page_id", F.col("__bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def deduplicate_pages(pages: DataFrame, path: str, *, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Write ``pages`` as deduplicated archives under ``path`` and return what reading them gives."""
    write_warc(warc_records(pages, resolve_revisits(payload_headers(pages))), path, records_per_file=records_per_file)
    return resolve_archive(read_warc(pages.sparkSession, path))


def roundtrip(pages: DataFrame) -> DataFrame:
    """``deduplicate_pages`` into a fresh folder under the shared checkpoint folder."""
    return deduplicate_pages(pages, scratch_path(pages.sparkSession, "warc"))


ORACLE = """
WITH h AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM h),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, payload_bytes, d.payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id <> first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
