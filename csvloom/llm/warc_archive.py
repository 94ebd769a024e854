"""Content-addressed web archive: payloads once, exact record headers apart, records rebuilt by joins.

An archive is two tables.  ``payloads`` holds every distinct payload once under its SHA-256; ``headers``
holds one row per record with the exact header bytes of a WARC/1.1 record and the digest of its payload.
Of records with equal payloads the one with the largest id is a ``response``, the others are ``revisit``
records that name it.  Reading joins the two on the digest, hashes the stored bytes anew and fails on any
that do not match, rebuilds the record and parses its header and payload out of it; the payload's SHA-1 is made anew.

Most payloads occur once.  A bitmap of fixed size over the digests that repeat tells them apart in the
scan, so single payloads go to the store without a shuffle and only repeated ones are grouped.

Defined results: a null payload is the empty one; payloads shorter than ``min_bytes`` are never shared; a
null URL gives a record without target, an empty one an empty target; CR and LF in a URL are percent-encoded, and such a URL
also stands in a field of its own in base64, so that every URL reads back as it was; of rows that repeat an
id and a payload, one is the response.  A null id counts as the smallest and is written as ``null``.  Payloads
are held one at a time, up to the two gigabytes of a binary value.  Empty tables give an empty archive.  Other
columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csvloom.llm.common import bitmap, bits_for, flag, stage

CRLF = "\r\n"
#: Fixed values of the formats written: RFC 4648 base32 digits, the WARC version and the revisit profile.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
#: Extension field for targets that a header line cannot hold.
EXACT_TARGET = "X-Exact-Target-Base64"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    payloads: DataFrame
    headers: DataFrame


def base32_of_hex(hex40: Column) -> Column:
    """Base32 of a SHA-1 given as 40 hexadecimal digits: five bytes at a time are eight digits, without padding."""
    alphabet = F.lit(BASE32)
    digits = []
    for part in range(4):
        five = F.conv(F.substring(hex40, part * 10 + 1, 10), 16, 10).cast("long")
        digits += [F.substring(alphabet, (F.shiftright(five, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*digits)


def _header(kind: str, date: str) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    def urn(c: Column) -> Column:
        return F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))

    uri = F.replace(F.replace(F.col("__url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    common = [
        F.lit(f"{VERSION}{CRLF}WARC-Type: {kind}{CRLF}"),
        line("WARC-Record-ID", urn(F.col("__id"))),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.when(uri != F.col("__url"), line(EXACT_TARGET, F.base64(F.col("__url").cast("binary")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("__sha1"))),
    ]
    if kind == "revisit":
        common += [line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", urn(F.col("__keep.__id")))]
        length = F.lit("0")
    else:
        common += [F.lit(f"Content-Type: text/html; charset=utf-8{CRLF}")]
        length = F.col("__n").cast("string")
    return F.concat(*common, line("Content-Length", length), F.lit(CRLF))


def write_archive(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z"
) -> Archive:
    """Write a record per row of ``pages`` into a new archive below the session's shared folder."""
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    seen = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), body.alias("__body")).withColumns(
        {"__sha256": F.unhex(F.sha2("__body", 256)), "__n": F.octet_length("__body").cast("long")}
    )
    facts = stage(
        seen.select("__id", "__url", "__sha256", "__n", base32_of_hex(F.sha1("__body")).alias("__sha1")).withColumn("__tag", F.monotonically_increasing_id()),
        "warc-facts",
    )
    groups = facts.groupBy("__sha256").agg(F.max(F.struct("__id", "__tag")).alias("__keep"), F.count("*").alias("__copies")).where("__copies > 1")
    # written, so that the join's sides are plain exchanges, of which Spark splits one that a large group makes long
    groups = stage(groups.select(F.col("__sha256").alias("__shared"), "__keep"), "warc-groups")
    bits = bits_for(groups)

    bodies = flag(seen.select("__sha256", "__body"), bitmap(groups, "__shared", bits=bits), "__again", F.col("__sha256"), bits=bits)
    single = bodies.where("not __again").select("__sha256", "__body")
    shared = bodies.where("__again").groupBy("__sha256").agg(F.first("__body").alias("__body"))
    payloads = stage(single.unionByName(shared).select(F.col("__sha256").alias("digest"), F.col("__body").alias("payload")), "warc-payloads")

    response = F.col("__keep").isNull() | (F.col("__tag") == F.col("__keep.__tag")) | (F.col("__n") < min_bytes)
    headers = facts.join(groups, F.col("__sha256") == F.col("__shared"), "left").select(
        F.col("__sha256").alias("digest"),
        F.when(response, _header("response", date)).otherwise(_header("revisit", date)).cast("binary").alias("header"),
    )
    return Archive(payloads, stage(headers, "warc-headers"))


def read_archive(archive: Archive) -> DataFrame:
    """Rebuild every record and parse its bytes; lengths and SHA-1 that differ from what the header says fail.

    Columns: ``record_id``, ``record_type``, ``refers_to``, ``target_uri``, ``payload_digest``, ``payload``
    (also a revisit's, from the store) and ``record``, the exact bytes of the WARC record.
    """
    stored = archive.payloads.withColumn(
        "payload",
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(
            F.raise_error(F.concat(F.lit("payload does not match its digest "), F.hex("digest"))).cast("binary")
        ),
    )
    end = F.lit(CRLF * 2).cast("binary")
    response = F.startswith(F.col("header").cast("string"), F.lit(f"{VERSION}{CRLF}WARC-Type: response{CRLF}"))
    rebuilt = archive.headers.join(stored, "digest").select(
        F.col("payload").alias("__stored"), F.concat("header", F.when(response, F.col("payload")).otherwise(F.lit("").cast("binary")), end).alias("record")
    )
    # from here on the record's own bytes count; of a revisit only the payload comes from the store
    split = rebuilt.withColumn("__head", F.concat(F.substring_index(F.col("record").cast("string"), CRLF * 2, 1), F.lit(CRLF)))

    def field(name: str, value: str = r"([^\r]*)") -> Column:
        line = rf"\r\n{name}: {value}\r\n"
        return F.when(F.col("__head").rlike(line), F.regexp_extract("__head", line, 1))

    begin = F.octet_length("__head") + len(CRLF)
    parsed = split.select(
        "*",
        field("WARC-Record-ID", r"<urn:x-page:([^>]*)>").alias("record_id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To", r"<urn:x-page:([^>]*)>").alias("refers_to"),
        F.coalesce(F.unbase64(field(EXACT_TARGET)).cast("string"), field("WARC-Target-URI")).alias("target_uri"),
        field("WARC-Payload-Digest", r"sha1:([A-Z2-7]*)").alias("__digest"),
        begin.alias("__begin"),
        field("Content-Length", r"(\d+)").cast("int").alias("__length"),
    )
    body = F.when(F.col("record_type") == "response", F.substring("record", F.col("__begin") + 1, F.col("__length"))).otherwise(F.col("__stored"))
    read = parsed.withColumn("__body", body).withColumn("__sha1", base32_of_hex(F.sha1("__body")))
    whole = F.octet_length("record") == F.col("__begin") + F.col("__length") + len(CRLF * 2)
    good = whole & (F.col("__sha1") == F.col("__digest"))

    def checked(name: str) -> Column:
        return F.when(good, F.col(name)).otherwise(F.raise_error(F.concat(F.lit("record does not match its header: "), F.col("__head"))))

    return read.select("record_id", "record_type", "refers_to", "target_uri", checked("__sha1").alias("payload_digest"), checked("__body").cast("binary").alias("payload"), "record")
