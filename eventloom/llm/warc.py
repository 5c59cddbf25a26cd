"""Content-addressed WARC archive: payload bytes once, record headers apart, whole records rebuilt by joins.

An archive is a folder of two Parquet tables.

* ``payloads``: ``digest`` (SHA-256 in hex) and ``payload``, one row for each distinct payload.
* ``headers``: one row a record: ``digest`` of its payload and ``header``, the exact bytes of everything in the record that
  precedes the payload: the WARC header and, behind it, the head of the HTTP message.

Of the records with equal payloads the one with the smallest page id is a ``response``, the others are ``revisit`` records that
name it; a revisit's own block ends with the HTTP head, its payload is the one its digest names.  ``read_records`` joins both
tables, takes every fact from the header bytes and the payload, and raises if a payload is missing or does not have its
digest.  ``record_bytes`` gives the record as it stands in a WARC file.

Equal digests are checked against a second one (SHA-1) and the length when written: two payloads under one SHA-256 raise.  Joins by
digest are salted, as one payload may belong to a third of all records; payloads travel once, records as numbers and headers.

Defined results: a null html is an empty payload; a null url has no target line; bytes of a url outside visible ASCII are
percent-encoded; rows that share the smallest id of a payload are all responses; a null id is written as an empty page line,
comes after all ids and refers to the response if there is one; payloads under ``smallest`` bytes are always responses; an
empty table gives an archive of no records; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.joins import salted_join
from eventloom.session import pin

#: Fixed values of the WARC format.
VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: The alphabets of number conversion in base 32 and of RFC 4648.
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The pages have no crawl date.
DATE = "1970-01-01T00:00:00Z"
ROWS_PER_TASK = 200_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: ten hex digits are eight of base 32."""
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(F.sha1(payload), at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]), DIGITS32, BASE32)


def encoded_url(url: Column) -> Column:
    """A url in one line of visible ASCII: other bytes as %XX."""
    plain = ~url.rlike(r"[^\x21-\x7E]")
    pieces = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"^[\x21-\x7E]?\z"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")))
    return F.when(plain, url).otherwise(F.array_join(pieces, ""))


def line(name: str, value: Column) -> Column:
    """A header line, empty where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def record_headers(rows: DataFrame, date: str = DATE) -> Column:
    """Bytes of a record before its payload, from ``page_id, url, sha1, bytes, of_id, of_url, kind``."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    revisit = F.col("kind") == "revisit"
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    return F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", name("page_id")), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", encoded_url(F.col("url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))), line("WARC-Refers-To", F.when(revisit, name("of_id"))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, encoded_url(F.col("of_url")))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", block.cast("string")), F.lit("\r\n"), http,
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, smallest: int = 0, date: str = DATE, rows_per_task: int = ROWS_PER_TASK) -> None:
    """Write an archive of one record per row of ``page_id, url, html``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    seen = pin(pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), base32_sha1(payload).alias("sha1"), F.octet_length(payload).cast("bigint").alias("bytes")))
    # one row a payload, combined before it travels: its first record, and both second facts from either end
    first = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("id"), F.col("url").isNull().alias("none"), F.col("url").alias("url"))
    facts = F.struct("sha1", "bytes")
    groups = seen.groupBy("digest").agg(F.min(first).alias("of"), F.min(facts).alias("low"), F.max(facts).alias("high"))
    same = F.when(F.col("low") == F.col("high"), F.col("of")).otherwise(F.raise_error(F.concat(F.lit("two payloads have the SHA-256 "), F.col("digest"))))
    groups = groups.select("digest", same.alias("of")).select("digest", F.col("of.id").alias("of_id"), F.col("of.url").alias("of_url"))
    again = (F.col("bytes") >= smallest) & ~F.col("page_id").eqNullSafe(F.col("of_id"))
    rows = salted_join(seen, groups, ["digest"], rows_per_task=rows_per_task).withColumn("kind", F.when(again, "revisit").otherwise("response"))
    rows.select("digest", record_headers(rows, date).alias("header")).write.parquet(f"{path}/headers")
    # the payload comes from a row of its own scan: equal digests are equal bytes, so any of the rows will do
    stored = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).groupBy("digest").agg(F.first("payload").alias("payload"))
    stored.write.parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Every record of an archive, rebuilt: ``page_id`` (as text; null: none), ``record_type``, ``refers_to`` (as text), ``url``,
    ``payload_digest``, ``payload_bytes``, ``header``, ``payload``."""
    headers, stored = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    good = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("a payload is not what its digest says: "), F.col("digest"))))
    verified = stored.select("digest", good.alias("payload")).withColumns({"sha1": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("bigint")})
    rows = salted_join(headers, verified, ["digest"], "left", rows_per_task)
    head = F.decode("header", "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(F.substring_index(head, END, 1), rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))
    page = lambda name: F.nullif(F.regexp_extract(field(name), "^<urn:page:(.*)>$", 1), F.lit(""))
    stated = F.substring_index(field("WARC-Payload-Digest"), ":", -1)
    digest = F.when(F.col("sha1").eqNullSafe(stated), stated).otherwise(F.raise_error(F.concat(F.lit("a record lacks its payload: "), F.col("digest"))))
    return rows.select(
        page("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("url"), digest.alias("payload_digest"), "payload_bytes", "header", "payload",
    )


def record_bytes(records: DataFrame) -> Column:
    """The record as it stands in a WARC file; a revisit has no payload in its block."""
    block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return F.concat(F.col("header"), block, F.lit(END).cast("binary"))
