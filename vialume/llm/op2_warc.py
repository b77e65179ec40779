"""Content-addressed web archive.

Writing stores each distinct payload once, under its SHA-256, in a payload table, and the exact header bytes of each
record in a record table; both are Parquet in the cluster's shared folder. Reading joins them back to whole WARC/1.1
records (header, empty line, payload, two line ends), verifies every payload against its address and the digest that its
header tells, and parses the records. Records carry a date and, with a payload, a content type. Payloads that are equal but under ``least_bytes`` long are all written as responses.

Of records with equal payloads the one with the largest page_id is the response, the others are revisits that refer to
it; of repeated rows with that page_id all are responses. Null html counts as an empty payload, a null page_id is
written as an empty id and reads back as null (smaller than any other id). Further columns are ignored. Joins carry only
digests besides the payload that they restore; adaptive execution splits hot digests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialume.llm.store import shared_dir

EOL = "\r\n"
#: The time of capture of pages that come without one.
EPOCH = "1970-01-01T00:00:00Z"
_HEX32, _RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 hex digits are eight groups of 20 bits, four base32 digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), _HEX32, _RFC32)


def write_archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0, date: str = EPOCH) -> str:
    """Write the archive of (page_id, url, html); returns its folder.

    ``date`` is the records' time of capture where the pages have none (a column ``fetched``, a timestamp).
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "") if "url" in pages.columns else F.lit("")
    at = F.lit(date)
    if dict(pages.dtypes).get("fetched") == "timestamp":
        at = F.coalesce(F.date_format(F.to_utc_timestamp("fetched", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), at)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), at.alias("at"), payload.alias("payload")).withColumn("address", F.sha2("payload", 256))
    rows.groupBy("address").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")

    ids = rows.select("page_id", "url", "at", "address", F.octet_length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("sha1"))
    best = ids.groupBy(F.col("address").alias("of")).agg(F.max("page_id").alias("response_id"))
    marked = ids.join(best, F.col("address") == F.col("of"), "left")
    revisit = (F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), text("page_id"), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.col("at")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), text("response_id"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(~revisit, F.lit("Content-Type: text/html; charset=utf-8")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
    ]
    header = F.encode(F.concat_ws(EOL, *lines), "UTF-8")
    marked.select("address", header.alias("header")).write.parquet(f"{path}/records")
    return path


def restore(spark, path: str) -> DataFrame:
    """Every record of an archive: header, the payload it stands for (verified), and the record's exact bytes."""
    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    verified = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its address "), F.col("address"))))
    payloads = payloads.select(F.col("address").alias("of"), verified.alias("payload"), base32_sha1(F.col("payload")).alias("sha1"))
    end = F.encode(F.lit(EOL + EOL), "UTF-8")
    none = F.encode(F.lit(""), "UTF-8")
    head = F.decode("header", "UTF-8")
    block = F.when(head.contains(EOL + "WARC-Type: revisit" + EOL), none).otherwise(F.col("payload"))
    told = F.concat(F.lit(EOL + "WARC-Payload-Digest: sha1:"), F.col("sha1"))
    header = F.when(F.concat(head, F.lit(EOL)).contains(F.concat(told, F.lit(EOL))), F.col("header")).otherwise(F.raise_error(F.concat(F.lit("header tells another digest: "), head)))
    return records.join(payloads, F.col("address") == F.col("of")).select(header.alias("header"), "payload", "sha1", F.concat("header", end, block, end).alias("record"))


def parse(records: DataFrame) -> DataFrame:
    """Fields of restored records; sizes and digests are those of the payload read back."""
    head = F.decode("header", "UTF-8")
    field = lambda name, rest: F.regexp_extract(head, f"\\r\\n{name}: {rest}", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    return records.select(
        number(field("WARC-Record-ID", "<urn:page:([^>]*)>")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        number(field("WARC-Refers-To", "<urn:page:([^>]*)>")).alias("refers_to"),
        F.octet_length("record").cast("long").alias("record_bytes"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)").alias("header_digest"),
    )


def archive_sql(table: str = "pages") -> str:
    """The rows of parse(restore(write_archive())) for DuckDB."""
    digit = lambda k: f"substr('{_RFC32}', CAST((CAST('0x' || substr(digest, {1 + 5 * (k // 4)}, 5) AS BIGINT) >> {15 - 5 * (k % 4)}) & 31 AS INT) + 1, 1)"
    return f"""
WITH rows AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM {table}),
hashed AS (SELECT page_id, url, octet_length(payload) AS n, sha1(payload) AS digest, sha256(payload) AS address FROM rows),
best AS (SELECT *, max(page_id) OVER (PARTITION BY address) AS response_id FROM hashed),
named AS (SELECT *, {' || '.join(digit(k) for k in range(32))} AS sha, page_id IS NOT DISTINCT FROM response_id AS first FROM best),
headed AS (SELECT *, concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: ' || CASE WHEN first THEN 'response' ELSE 'revisit' END, 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>', 'WARC-Date: {EPOCH}',
  'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[' || chr(13) || chr(10) || ']', '', 'g'), 'WARC-Payload-Digest: sha1:' || sha, CASE WHEN NOT first THEN 'WARC-Refers-To: <urn:page:' || response_id || '>' END,
  CASE WHEN NOT first THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' END, CASE WHEN first THEN 'Content-Type: text/html; charset=utf-8' END, 'Content-Length: ' || CASE WHEN first THEN n ELSE 0 END) AS header FROM named)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha AS payload_digest, CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT first THEN response_id END AS refers_to,
  CAST(octet_length(encode(header)) + 8 + CASE WHEN first THEN n ELSE 0 END AS BIGINT) AS record_bytes, sha AS header_digest
FROM headed"""
