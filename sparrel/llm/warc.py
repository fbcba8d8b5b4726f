"""A content-addressed WARC archive.

An archive is two Parquet tables: payloads (digest, payload: every distinct payload once) and records (the exact header bytes of every record, up to the
payload, and its digest).  A record's bytes come back by joining the two.  The digest is SHA-256; equal digests are checked for equal length and for an equal
second hash, and reading computes the digest of the stored bytes again.

Of records with equal payloads of at least MIN_REVISIT_BYTES, the one with the smallest page id (null ids last, then the smallest url; of rows equal in both,
the first copy) is the response and the others revisit it.  Smaller payloads are responses all, though their bytes are stored once too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
_CRLF = "\r\n"
_RECORDS = "page_id bigint, digest string, header binary"


def _line(name: str, *value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), *[F.lit(v) if isinstance(v, str) else v for v in value], F.lit(_CRLF))


def _uuid(h: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record_id(page_id: Column, url: Column, copy: Column) -> Column:
    return _uuid(F.sha2(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(url, F.lit("")), copy.cast("string")), 256))


def _header() -> Column:
    revisit, url = F.col("record_type") == "revisit", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(_CRLF * 2))
    owner = F.col("owner")
    return F.concat(
        F.lit(f"WARC/1.1{_CRLF}"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("copy"))),
        _line("WARC-Date", DATE), _line("WARC-Target-URI", url), _line("WARC-Payload-Digest", "sha256:", F.col("digest")),
        F.when(revisit, F.concat(_line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), _line("WARC-Refers-To", _record_id(owner["page_id"], owner["url"], F.lit(0))))).otherwise(""),
        F.when(F.col("page_id").isNotNull(), _line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        F.when(revisit & owner["page_id"].isNotNull(), _line("X-Refers-To-Page-ID", owner["page_id"].cast("string"))).otherwise(""),
        _line("Content-Type", "application/http;msgtype=response"), _line("Content-Length", (F.length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")), F.lit(_CRLF), http,
    ).cast("binary")


def write(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Archive the rows of pages (page_id, url, html; null html is an empty payload) under path.  Repeated rows are records of their own."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    known = common.written(pages.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.xxhash64("payload").alias("second")), "warc-known")
    rows = known.groupBy("page_id", "url", "digest", "bytes", "second").agg(F.count("*").alias("copies"))
    first = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")
    owners = known.groupBy("digest").agg(F.min(first).alias("owner"), F.min("bytes").alias("a"), F.max("bytes").alias("b"), F.min("second").alias("c"), F.max("second").alias("d"))
    owners = owners.select("digest", F.when((F.col("a") == F.col("b")) & (F.col("c") == F.col("d")), F.col("owner")).otherwise(F.raise_error(F.concat(F.lit("different payloads have the digest "), F.col("digest")))).alias("owner"))

    key = lambda page_id, url: F.concat_ws("\n", "digest", F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(url, F.lit("\n"))).alias("key")
    kept = pages.select("digest", "payload", key(F.col("page_id"), F.col("url"))).join(owners.select(key(F.col("owner.page_id"), F.col("owner.url"))), "key", "left_semi")
    kept.dropDuplicates(["key"]).select("digest", "payload").write.parquet(f"{path}/payloads")  # a repeated row's copies meet in the join's partitions

    records = rows.join(owners, "digest").select("*", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
    own = F.col("page_id").eqNullSafe(F.col("owner.page_id")) & F.col("url").eqNullSafe(F.col("owner.url")) & (F.col("copy") == 0)
    records = records.withColumn("record_type", F.when((F.col("bytes") < min_revisit_bytes) | own, "response").otherwise("revisit"))
    records.select("page_id", "digest", _header().alias("header")).write.parquet(f"{path}/records")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for every record; lengths and digests are those of the bytes read."""
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    seen = payloads.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    seen = seen.withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.lit("a stored payload differs from its digest"))))
    records = spark.read.schema(_RECORDS).parquet(f"{path}/records").select(
        _field("X-Page-ID").cast("long").alias("page_id"), F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "").alias("digest"), _field("WARC-Type").alias("record_type"), _field("X-Refers-To-Page-ID").cast("long").alias("refers_to"))
    return records.join(seen, "digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (the record's bytes in a WARC file), payload (also of revisits) for every record."""
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    records = spark.read.schema(_RECORDS).parquet(f"{path}/records").join(payloads, "digest")
    body = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("page_id", F.concat("header", body, F.lit((_CRLF * 2).encode())).alias("record"), "payload")
