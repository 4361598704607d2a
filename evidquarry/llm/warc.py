"""WARC archives: writing captures and assembling transactions from their records.

Writing. Every page gives three records: a ``request``, a ``metadata`` record (page id and
payload length) and a ``response`` with the payload; the first two name the third in
``WARC-Concurrent-To``. Of pages with equal payloads one with the largest id (and then the last
url) keeps the payload; the others become ``revisit`` records that refer to it. Rows that repeat
id, url and payload are numbered, and the number is part of their record ids, so each is a
capture of its own; only such rows are counted and spread again. Records are built from
columns and written by Spark's text writer, whose line separator is the blank lines that end
a record, so the archives (gzip) can live in any store Spark reaches. A file holds as many
records as make about ``FILE_BYTES`` on average.

Reading. A file is read whole and walked record by record by ``Content-Length`` (payloads may
hold anything, also record headers). Records are joined through their concurrent-to
identifiers in one grouping: a record's key is the identifier it is concurrent to, or its own.
Each capture comes out as one nested row (request, response, metadata).

Defined results: a null payload is empty; a null url is written as empty, control characters
in a url are percent-encoded; every row is one capture and gives one row, repeated rows too;
a page without an id is kept under a null id and counts as smaller than every id; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidquarry.llm.base import fresh_path, stored, table

FILE_BYTES = 16 << 20
END = "\r\n\r\n"
SPREAD = 1000  # repeats of one row written in a stretch
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32(digest_hex: Column) -> Column:
    """Base32 of a hex digest of 20 bytes: 40 bits, or 8 letters, at a time."""
    def part(at: int) -> Column:
        digits = F.lpad(F.conv(F.substring(digest_hex, at, 10), 16, 32), 8, "0")
        return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*(part(at) for at in (1, 11, 21, 31)))


def _urn(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _record(kind: str | Column, urn: Column, url: Column, content_type: str, block: Column, *fields: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), urn, F.lit("\r\nWARC-Date: " + DATE + "\r\nWARC-Target-URI: "), url,
        *fields, F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with their number among equal ones (page, url, sha, bytes), from 1.

    Only keys that repeat travel, as a written table of known size: one row of each is
    multiplied again in stretches of SPREAD.
    """
    keys = ["page", "url", "sha", "bytes"]
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
    repeated = stored(rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1"), "repeats")
    once = rows.alias("r").join(repeated.alias("k"), same, "left_anti").withColumn("number", F.lit(1).cast("long"))
    first = rows.alias("r").join(repeated.alias("k"), same).select("r.*", "k.times").dropDuplicates(keys)
    stretches = first.withColumn("from", F.explode(F.expr(f"sequence(1L, times, {SPREAD}L)"))).repartition("sha", "page", "url", "from")
    again = stretches.withColumn("number", F.explode(F.expr(f"sequence(from, least(times, from + {SPREAD - 1}L))"))).drop("times", "from")
    return once.unionByName(again)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write request, response or revisit, and metadata records of all pages under *path*."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\\x00-\\x20\\x7F]", "%20").alias("url"),
        payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("bytes"))
    order = F.struct("page", "url")
    leads = stored(rows.groupBy("sha", "bytes").agg(F.max(order).alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n"), "leads")
    average = rows.agg(F.avg("bytes")).first()[0] or 0
    joined = _numbered(rows).join(leads, ["sha", "bytes"], "left")
    page, url, sha, number = F.col("page"), F.col("url"), F.col("sha"), F.col("number")
    is_lead = page.eqNullSafe(F.col("lead.page")) & (url == F.col("lead.url")) & (number == 1)
    same = F.col("lead").isNotNull() & ~is_lead
    urn = _urn(F.lit("response"), page, url, sha, number)
    lead_urn = _urn(F.lit("response"), F.col("lead.page"), F.col("lead.url"), sha, F.lit(1))
    digest = F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(sha))
    concurrent = F.concat(F.lit("\r\nWARC-Concurrent-To: "), urn)
    head = F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit(END))
    refers = F.concat(F.lit("\r\nWARC-Refers-To: "), lead_urn, F.lit("\r\nWARC-Refers-To-Target-URI: "), F.col("lead.url"), F.lit(f"\r\nWARC-Profile: {PROFILE}"))
    capture = _record(
        F.when(same, "revisit").otherwise("response"), urn, url, "application/http; msgtype=response",
        F.when(same, head).otherwise(F.concat(head, F.col("payload"))), digest, F.when(same, refers).otherwise(""))
    request = _record("request", _urn(F.lit("request"), page, url, sha, number), url, "application/http; msgtype=request",
                      F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1" + END)), concurrent)
    about = F.concat(
        F.lit("page-id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit("\r\npayload-length: "), F.col("bytes").cast("string"),
        F.lit("\r\nrefers-to-page: "), F.when(same, F.coalesce(F.col("lead.page").cast("string"), F.lit(""))).otherwise(""), F.lit("\r\n"))
    metadata = _record("metadata", _urn(F.lit("metadata"), page, url, sha, number), url, "application/warc-fields", about, concurrent)
    (
        joined.select(F.explode(F.array(request, capture, metadata)).alias("value"))
        .write.option("lineSep", END).option("compression", "gzip")
        .option("maxRecordsPerFile", max(3, int(3 * FILE_BYTES / (average + 600)))).text(path)
    )


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {lines[0][:60]!r}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "type", "record_id", "uri", "date", "refers_to", "digest", "payload_bytes", "payload", "block"]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for file in batch.column(0):
            rows, size = [], 0
            for fields, block in _records(gzip.decompress(file.as_py())):
                kind, own = fields["WARC-Type"], fields["WARC-Record-ID"]
                payload = digest = None
                if kind == "response":
                    payload = block.split(b"\r\n\r\n", 1)[1]
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                elif kind == "revisit":
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                rows.append((
                    fields.get("WARC-Concurrent-To", own), kind, own, fields.get("WARC-Target-URI"), fields.get("WARC-Date"),
                    fields.get("WARC-Refers-To"), digest, None if payload is None else len(payload),
                    None if payload is None else payload.decode("utf-8"), block.decode("utf-8") if kind in ("request", "metadata") else None))
                size += len(block)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_transactions(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One nested row (capture, request, response, metadata) per capture in the archives."""
    records = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(
        _parsed,
        "key string, type string, record_id string, uri string, date string, refers_to string, digest string, payload_bytes long, payload string, block string")
    response = ["record_id", "type", "uri", "date", "refers_to", "digest", "payload_bytes", *(["payload"] if with_payload else [])]
    field = lambda name: F.regexp_extract("block", rf"(?m)^{name}: (.*?)\r?$", 1)
    about = F.struct(
        "record_id", field("page-id").alias("page_id"), field("payload-length").cast("long").alias("payload_length"), field("refers-to-page").alias("refers_to_page"))
    return records.groupBy(F.col("key").alias("capture")).agg(
        F.max(F.when(F.col("type") == "request", F.struct("record_id", "uri", F.col("block").alias("message")))).alias("request"),
        F.max(F.when(F.col("type").isin("response", "revisit"), F.struct(*response))).alias("response"),
        F.max(F.when(F.col("type") == "metadata", about)).alias("metadata"),
    )


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    number = lambda name: F.when(F.col(name) != "", F.col(name).cast("long"))
    return read_transactions(spark, path, with_payload=False).select(
        number("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_length").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        number("metadata.refers_to_page").alias("refers_to"))


QUERIES = {"op8_warc_transactions": op8_warc_transactions}
ORACLES = {
    "op8_warc_transactions": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS lead,
  row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC) = 1 AS first FROM p),
b AS (SELECT page_id, payload_bytes, lead, first, array_to_string(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((strpos('0123456789abcdef', x[(5*i)//4 + 1]) - 1) * 16
    + (CASE WHEN (5*i)//4 + 2 <= 40 THEN strpos('0123456789abcdef', x[(5*i)//4 + 2]) - 1 ELSE 0 END)) // (1 << (3 - (5*i) % 4))) % 32, 1)), '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN NOT first THEN lead END AS refers_to FROM b""",
}
