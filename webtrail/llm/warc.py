"""Content-addressed WARC archive.

`write` stores every payload once, under its SHA-256, and the exact header block of every
record apart from it. `records` reads both back and rebuilds the original records by a join
on the digest; every stored payload is digested again on the way, so damage is an error.

Defined cases: a null payload is empty. Rows that repeat the smallest page_id of a payload
are responses, each of them; a null page_id sorts after all others and is a response only if
no row of that payload has one. A null url gives the target `urn:page:<id>`; CR, LF, NUL and
spaces in a url are percent-encoded in the header, the column keeps it as it was. Other
columns of the input are ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail.llm.common import query, table, work_path

MIN_REVISIT_BYTES = 100
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    headers: str
    payloads: str


def write(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """pages: page_id, url, html. Two tables below `path`.

    Payloads are combined by digest before they are shuffled, so copies travel once per task;
    the join that gives every page its first copy carries digests only."""
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))

    archive = Archive(f"{path}/headers", f"{path}/payloads")
    stored = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"), F.first("bytes").alias("bytes"), F.min("page_id").alias("first_id"),
        F.min(F.xxhash64("payload")).alias("low"), F.max(F.xxhash64("payload")).alias("high"))
    one = F.assert_true(F.col("low") == F.col("high"), F.concat(F.lit("two payloads share digest "), F.col("digest")))
    stored.select("digest", "payload", F.when(one.isNull(), F.col("bytes")).alias("bytes"), "first_id").write.parquet(archive.payloads)

    known = pages.sparkSession.read.parquet(archive.payloads).select("digest", "first_id", "bytes")
    joined = rows.select("page_id", "url", "digest").join(known, "digest")
    revisit = (F.col("bytes") >= min_revisit_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    joined = joined.select("page_id", "url", "digest", "bytes", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))
    joined.select("page_id", "url", "digest", header(date).alias("header")).write.parquet(archive.headers)
    return archive


def _record_id(page) -> F.Column:
    hexed = F.sha2(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("null"))), 256)
    part = lambda at, n: F.substring(hexed, at, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def header(date: str) -> F.Column:
    """The header block of a record, up to and with its empty line. A revisit has no block of
    its own: its length is 0 and its digest names the payload it refers to."""
    target = F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    for raw, coded in (("\r", "%0D"), ("\n", "%0A"), ("\x00", "%00"), (" ", "%20")):
        target = F.replace(target, F.lit(raw), F.lit(coded))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    again = F.col("revisit")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target),
        line("WARC-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(
            line("WARC-Refers-To", _record_id(F.col("refers_to"))),
            line("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string")),
            line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF))


def field(header_block, name: str) -> F.Column:
    """The value of a header line, null where there is none."""
    found = F.regexp_extract(header_block, rf"\n(?i:{name}): ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The archive read back: one row per record with page_id, url, header, the record's own
    bytes, the payload it stands for and that payload's verified digest and length."""
    payloads = spark.read.parquet(archive.payloads)
    again = F.sha2("payload", 256)
    whole = F.assert_true((again == F.col("digest")) & (F.octet_length("payload") == F.col("bytes")), F.concat(F.lit("damaged payload "), F.col("digest")))
    payloads = payloads.select("digest", "payload", F.when(whole.isNull(), again).alias("verified"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    headers = spark.read.parquet(archive.headers).select("url", "header")
    headers = headers.withColumn("digest", F.substring_index(field(F.col("header"), "WARC-Payload-Digest"), ":", -1))
    rows = headers.join(payloads, "digest")
    kind, length = field(F.col("header"), "WARC-Type"), field(F.col("header"), "Content-Length").cast("long")
    block = F.when(kind == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    fits = F.assert_true(F.octet_length(block) == length, F.lit("a record's length differs from its header"))
    return rows.select(
        field(F.col("header"), "WARC-Page-ID").cast("long").alias("page_id"), "url", "header",
        F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"), "payload",
        F.when(fits.isNull(), F.col("payload_bytes")).alias("payload_bytes"), F.col("verified").alias("payload_digest"),
        kind.alias("record_type"), field(F.col("header"), "WARC-Refers-To-Page-ID").cast("long").alias("refers_to"))


def export(rows: DataFrame, path: str) -> None:
    """Records as WARC text files: Spark's text writer ends each with the record's last CRLF."""
    text = F.decode(F.col("record"), "UTF-8")
    rows.select(F.substring(text, F.lit(1), F.length(text) - 2).alias("value")).write.option("lineSep", CRLF).text(path)


CHECK = f"""
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first_id FROM pages)
"""


@query("op2_warc", CHECK)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    archive = write(table(spark, sf, "pages"), work_path(spark, "warc"))
    return records(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
