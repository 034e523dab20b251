"""WARC archives with revisit records: write deduplicated archives, read them back.

Headers (digest, page id) are shuffled by payload digest; pre-aggregated to one
row per digest, they are joined back to the records, which become a response
(smallest page id of the digest) or a revisit that refers to it and has no
payload. Archives are written by Spark's text writer as gzip files, one record after another,
and read back as binary files that are parsed by Content-Length.

Defined results: a null html is an empty payload; payloads below ``min_bytes``
are all responses; repeated rows with the same page id and payload are written
each and share their record type; a null page id is never referred to and is a
response; a null url is written as an empty target; an empty table gives
archives without records. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir

CRLF = "\r\n"
VERSION = "WARC/1.1"
#: Fixed value: the capture date of records whose source has none.
DATE = "1970-01-01T00:00:00Z"
RECORDS_PER_FILE = 2_000


def base32_sha1(binary: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column, with built-in functions."""
    digest = F.sha1(binary)
    groups = []
    for i in range(8):  # 20 bits are four base32 digits
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            value = F.shiftright(bits, shift).bitwiseAND(F.lit(31))
            groups.append(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), value + 1, F.lit(1)))
    return F.concat(*groups)


def resolve_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, refers_url) per page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", base32_sha1(F.encode("payload", "UTF-8")))
    heads = (rows.where("page_id is not null").where(F.col("payload_bytes") >= min_bytes)
             .groupBy("payload_digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("payload_digest", "first"))
    is_first = F.col("first").isNull() | F.col("page_id").isNull() | (F.col("page_id") == F.col("first.page_id"))
    return rows.join(heads, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(is_first, "response").otherwise("revisit").alias("record_type"),
        F.when(~is_first, F.col("first.page_id")).alias("refers_to"),
        F.when(~is_first, F.col("first.url")).alias("refers_url"))


def _clean(value: Column) -> Column:
    """A header value: line breaks would end the header, so they are percent-encoded."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archives(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write resolved records below ``path``; each file holds whole records with fresh headers."""
    response = F.col("record_type") == "response"
    body = F.when(response, F.col("payload")).otherwise("")
    lines = [
        F.concat(F.lit(VERSION + CRLF + "WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")), F.lit(CRLF + "WARC-Refers-To-Target-URI: "),
                                   _clean(F.col("refers_url")),
                                   F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")),
        F.concat(F.lit("Content-Type: application/octet-stream" + CRLF + "Content-Length: "), F.octet_length(body)),
    ]
    text = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), body)
    (records.select(text.alias("value")).write.mode("errorifexists").option("lineSep", CRLF + CRLF)
     .option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record of one archive file, plain or gzip; a malformed file raises ValueError."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(VERSION.encode(), at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8").split(CRLF)[1:]
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        begin = end + 4
        at = begin + int(headers["Content-Length"])
        body = data[begin:at]
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {begin} is cut")
        at += 4
        yield headers, body


RECORD = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
          "payload binary, intact boolean")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``: one task reads whole files, each of bounded record count.

    ``intact`` says whether a response's payload has the digest of its header.
    """

    def number(value: str | None) -> int | None:
        digits = (value or "").removeprefix("<urn:page:").rstrip(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for content in part["content"]:
                out = []
                for h, body in parse_records(content):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    full = h["WARC-Type"] == "response"
                    out.append((number(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], digest,
                                int(h["X-Payload-Length"]), number(h.get("WARC-Refers-To")), body if full else None,
                                not full or base64.b32encode(hashlib.sha1(body).digest()).decode() == digest))
                frame = pd.DataFrame(out, columns=["page_id", "url", "record_type", "payload_digest", "payload_bytes",
                                                   "refers_to", "payload", "intact"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64", "intact": "boolean"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(run, RECORD)


def archive_path(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder for one run's archives."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4().hex}"
