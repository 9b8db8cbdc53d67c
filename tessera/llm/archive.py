"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, the exact header bytes of each record apart from them, and records
are put together again by a join on the digest. What is read back is verified: the digest is computed anew from the
stored bytes and must equal the one it is stored under.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.skew import lookup_join
from tessera.session import stage

CRLF = "\r\n"
#: Payloads of fewer bytes are always written as responses.
MIN_REVISIT_BYTES = 1000
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Two Parquet tables: ``payloads`` (sha256, payload, copies), ``headers`` (record_id, sha256, header)."""

    spark: SparkSession
    payloads: DataFrame
    headers: DataFrame


def _line(name: str, value: Column) -> Column:
    """One header line; nothing for a null value. Line breaks of a value are percent-encoded, so it stays one line."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def header_bytes(record_id: Column, uri: Column, sha1: Column, size: Column, refers_to: Column, date: str) -> Column:
    """The header block of a record, up to and with the empty line; a revisit has a block of no bytes."""
    revisit = refers_to.isNotNull()
    lines = [
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:record:"), record_id.cast("string"), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:record:"), refers_to.cast("string"), F.lit(">"))),
        _line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(size).cast("string")),
        F.lit(CRLF),
    ]
    return F.concat(*lines).cast("binary")


def write_archive(
    pages: DataFrame, record_id: str = "page_id", uri: str = "url", body: str = "html", date: str = "1970-01-01T00:00:00Z",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> Archive:
    """Archive one record per row of ``pages``.

    Null or empty bodies are payloads of no bytes. Of records with equal payloads of at least ``min_revisit_bytes``
    that with the largest id is the response and the others revisit it; rows that repeat the largest id are responses
    too, a null id revisits. Other columns of ``pages`` are not read, so their names cannot clash. An empty table gives
    an empty archive. Payloads move once, grouped by digest with copies combined before the shuffle; the join that
    tells each record its response moves only ids and digests, and splits a digest that many records share.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(record_id).alias("record_id"), F.col(uri).cast("string").alias("uri"), payload.alias("payload")
    ).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    facts = stage(
        rows.select("record_id", "uri", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size")),
        "records",
    )
    payloads = stage(
        rows.groupBy("sha256").agg(
            F.first("payload").alias("payload"), F.max("record_id").alias("newest"), F.count(F.lit(1)).alias("copies")
        ),
        "payloads",
    )
    newest = payloads.select("sha256", "newest", "copies")
    known = lookup_join(facts, newest, ["sha256"], "copies", "record_id")
    older = (F.col("size") >= min_revisit_bytes) & ~F.col("record_id").eqNullSafe(F.col("newest"))
    refers_to = F.when(older, F.col("newest"))
    header = header_bytes(F.col("record_id"), F.col("uri"), F.col("sha1"), F.col("size"), refers_to, date)
    headers = stage(known.select("record_id", "sha256", header.alias("header")), "headers")
    return Archive(spark, payloads.select("sha256", "payload", "copies"), headers)


def header_field(header: Column, name: str) -> Column:
    """A field of header bytes; null if the header lacks it."""
    found = F.regexp_extract(header.cast("string"), rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def restore(archive: Archive, strict: bool = True) -> DataFrame:
    """Each record as ``record_id, header, payload, payload_bytes, payload_digest, verified, record_type, refers_to``.

    Length and SHA-1 come from the stored payload, type and reference from the stored header. ``verified`` tells that
    the payload hashes to the digest it is stored under. With ``strict`` whoever reads a payload's length, digest or
    bytes gets an error for one that does not; without, the row with ``verified`` false. Columns that a reader drops
    are not moved by the join.
    """
    intact = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    fault = F.concat(F.lit("payload does not hash to "), F.lower(F.hex("sha256")))
    checked = lambda c: F.when(intact, c).otherwise(F.raise_error(fault)) if strict else c
    stored = archive.payloads.select(
        "sha256", "copies", checked(F.col("payload")).alias("payload"),
        checked(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        checked(F.sha1("payload")).alias("payload_digest"),
        intact.alias("verified"),
    )
    whole = lookup_join(archive.headers, stored, ["sha256"], "copies", "record_id")
    refers_to = F.regexp_extract(header_field(F.col("header"), "WARC-Refers-To"), r"^<urn:record:(.*)>$", 1)
    return whole.select(
        "record_id", "header", "payload", "payload_bytes", "payload_digest", "verified",
        header_field(F.col("header"), "WARC-Type").alias("record_type"), refers_to.alias("refers_to"),
    )


def record_bytes(restored: DataFrame) -> DataFrame:
    """``record_id, record``: the bytes of each WARC record as it stands in a file, without its two closing breaks."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return restored.select("record_id", F.concat("header", block).alias("record"))


def export_files(restored: DataFrame, folder: str, compression: str = "none") -> None:
    """Write WARC files, one per task. The two line breaks that end a record are the writer's separator."""
    record = record_bytes(restored).select(F.col("record").cast("string").alias("value"))
    record.write.option("lineSep", CRLF + CRLF).option("compression", compression).text(folder)
