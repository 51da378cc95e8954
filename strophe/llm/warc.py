"""Operator 4: a content-addressed WARC archive.

``write_archive`` keeps two tables in the archive's folder: ``payloads``, each payload's bytes once under
the SHA-256 digest of those bytes, and ``records``, the exact header block of every record with the digest
of its payload. The payloads of one digest are combined before the shuffle, and their lengths and SHA-1
digests must agree, or the write fails. ``reconstruct`` joins the two into whole records, byte by byte,
and ``export_warc`` writes those as .warc files with Spark's text sink. ``read_archive`` hashes the stored
bytes again, fails on a payload that does not match its name, reconstructs every record and reads its
results from the records' own bytes.

Of equal payloads of at least ``min_bytes`` bytes the record with the smallest page_id is a response and
the others are revisits of it; smaller ones are responses all. Null html is an empty payload, a null url
an empty one; line ends within a url are written as %0D and %0A. Rows that repeat the smallest page_id
are each a response; a null page_id is larger than all others. An empty table gives an empty archive;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, scratch_path

#: RFC 4648 base32.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2026-01-01T00:00:00Z"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of 40 hexadecimal digits: five of them are four characters."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substring(digest, g * 5 + 1, F.lit(5)), 16, 10).cast("long"))
    signs = F.flatten(F.transform(groups, lambda v: F.array(*[F.substring(F.lit(ALPHABET), (F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)])))
    return F.array_join(signs, "")


def _header(kind: Column) -> Column:
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    common = [F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1")]
    response = F.concat(F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"))
    revisit = F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")), F.lit("\r\nContent-Length: 0"))
    return F.concat(*common, F.when(kind == "response", response).otherwise(revisit), F.lit("\r\n\r\n"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    rows = picked(pages, page_id="page_id", url="url", html="html").select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    hashed = rows.withColumns({"digest": F.sha2("payload", 256), "sha1_hex": F.sha1("payload"), "bytes": F.length("payload").cast("long")})
    facts = F.struct("bytes", "sha1_hex")
    stored = hashed.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("page_id").alias("first"), F.min(facts).alias("low"), F.max(facts).alias("high"))
    agreed = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.concat(F.lit("different payloads of digest "), F.col("digest"))))
    stored.withColumn("low", agreed).select("digest", "first", F.col("low.bytes").alias("bytes"), base32_of_hex(F.col("low.sha1_hex")).alias("sha1"), "payload").write.parquet(f"{path}/payloads")

    facts_of = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "first", "bytes", "sha1")
    keyed = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest")).join(facts_of, "digest")
    again = (F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    keyed.select("page_id", "digest", _header(kind).alias("header")).write.parquet(f"{path}/records")


def _joined(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (its whole bytes), digest, payload and its facts, of every record; payloads are
    hashed where they are stored, once each."""
    stored = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))))
    payloads = stored.select("digest", checked.alias("payload")).select("digest", "payload", F.length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("found"))
    records = spark.read.parquet(f"{path}/records")
    body = F.when(_type() == "response", F.col("payload")).otherwise(F.lit(b""))
    whole = F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n"))
    return records.join(payloads, "digest").select("page_id", whole.alias("record"), "payload_bytes", "found")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record: the whole bytes of every record, header, payload and the two line ends after it."""
    return _joined(spark, path).select("page_id", "record")


def export_warc(spark: SparkSession, path: str, to: str, compression: str = "none") -> None:
    """Writes the archive as WARC files below to. The sink ends each row with the record's last line feed."""
    whole = reconstruct(spark, path)
    whole.select(F.expr("cast(substring(record, 1, length(record) - 1) as string)").alias("value")).write.option("lineSep", "\n").option("compression", compression).text(to)


def _field(name: str, pattern: str = "([^\\r]*)") -> Column:
    return F.regexp_extract("header", f"\\r\\n{name}: {pattern}\\r\\n", 1)


def _type() -> Column:
    return _field("WARC-Type")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read from the reconstructed records.

    A record's header ends at its first empty line; Content-Length bytes and two line ends must follow it,
    the body of a response must have the header's digest, and the payload that a revisit stands for too.
    """
    text = F.col("record").cast("string")
    split = _joined(spark, path).withColumn("header", F.left(text, F.locate("\r\n\r\n", text) + 3))
    number = "<urn:page:(\\d+|-\\d+|[^>]*)>"
    size = _field("Content-Length", "(\\d+)").cast("long")
    parsed = split.select(
        "page_id", "record", "payload_bytes", "found", F.octet_length("header").alias("at"), size.alias("size"), _type().alias("record_type"), _field("WARC-Record-ID", number).alias("id"),
        _field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)").alias("written"), F.nullif(_field("WARC-Refers-To", number), F.lit("")).alias("to"),
    )
    body = F.substring(F.col("record"), F.col("at") + 1, F.col("size").cast("int"))
    framed = F.octet_length("record") == F.col("at") + F.col("size") + 4
    own = F.when(F.col("record_type") == "response", base32_of_hex(F.sha1(body)) == F.col("written")).otherwise(F.col("size") == 0)
    named = F.col("id") == F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    sound = framed & own & named & (F.col("written") == F.col("found"))
    digest = F.when(sound, F.col("written")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("id"))))
    length = F.when(F.col("record_type") == "response", F.col("size")).otherwise(F.col("payload_bytes"))
    kind = split.schema["page_id"].dataType
    return parsed.select("page_id", length.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("to").cast(kind).alias("refers_to"))


def archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes the archive and reads it back."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_bytes)
    return read_archive(pages.sparkSession, path)
