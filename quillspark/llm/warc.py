"""Content-addressed WARC archive.

Payload bytes are stored once each, under their SHA-256. Exact record headers
are kept apart, one row per record. Reading joins the two back into the original
record bytes and verifies that each payload still has its digest.

Which page stores a payload is settled on digests alone (an aggregate of a few
bytes per row), so hot payloads never gather in one task; payload bytes are
shuffled once, by page.

Defined results: null html is an empty payload; a null page_id is archived under
an empty record id and ranks below every other; repeated rows give a record
each; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 1000
_EOL = "\r\n"
_NONE = -(2**63)


def _headers() -> Column:
    """The header block of one record, from its columns."""
    is_revisit = F.col("refers_to").isNotNull()
    lines = [
        F.lit("WARC/1.1"),
        F.when(is_revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.when(is_revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit(_EOL),
    ]
    return F.concat_ws(_EOL, *lines)  # skips the nulls


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write ``path``/records (page_id, headers, payload_sha256) and ``path``/payloads (payload_sha256, payload)."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"))
    keyed = source.withColumn("payload_sha256", F.sha2("payload", 256))
    rows = keyed.select("page_id", "url", "payload_sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    owners = rows.groupBy("payload_sha256").agg(F.max("page_id").alias("owner"))
    refers = F.when((F.col("n") >= min_revisit) & (F.col("page_id").isNull() | (F.col("page_id") < F.col("owner"))), F.col("owner"))
    records = rows.join(owners, "payload_sha256").withColumn("refers_to", refers)
    records.select("page_id", _headers().alias("headers"), "payload_sha256").write.parquet(f"{path}/records")
    at = F.coalesce("page_id", F.lit(_NONE))
    kept = keyed.select(at.alias("at"), "payload_sha256", "payload")
    stored = kept.join(owners.select(F.coalesce("owner", F.lit(_NONE)).alias("at"), "payload_sha256"), ["at", "payload_sha256"])
    # grouped as it is joined: rows that repeat page and payload are stored once, with no further exchange
    stored.groupBy("at", "payload_sha256").agg(F.first("payload").alias("payload")).select("payload_sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def _verified(payloads: DataFrame) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("payload_sha256"))).cast("binary")
    return payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("payload_sha256"), F.col("payload")).otherwise(bad))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (the original record's bytes), payload (in full, for revisits too)."""
    payloads = _verified(spark.read.parquet(f"{path}/payloads"))
    records = spark.read.parquet(f"{path}/records")
    own = F.when(F.col("headers").contains("WARC-Type: revisit"), F.lit("").cast("binary")).otherwise(F.col("payload"))
    end = F.lit(_EOL * 2).cast("binary")
    return records.join(payloads, "payload_sha256").select("page_id", F.concat(F.col("headers").cast("binary"), own, end).alias("record"), "payload")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as the archive's records and payloads say.

    Payloads are verified and measured before the join, so only digests travel.
    """
    measured = _verified(spark.read.parquet(f"{path}/payloads")).select("payload_sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    records = spark.read.parquet(f"{path}/records").select(
        "page_id",
        "payload_sha256",
        F.regexp_extract("headers", r"\r\nWARC-Type: (\w+)", 1).alias("record_type"),
        F.regexp_extract("headers", r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>", 1).alias("target"),
    )
    return records.join(measured, "payload_sha256").select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("target") != "", F.col("target").cast("long")).alias("refers_to"))
