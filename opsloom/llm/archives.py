"""Legacy archives to WARC: ARC files of version 1 and 2 are parsed by their header lines and declared lengths, and each
record becomes a WARC record with a synthesised identifier, timestamp, type and payload digest.

Files are gzip streams written and read through Spark, so any store that Spark reaches will do; a file holds at most
``FILE_RECORDS`` records. Null payloads count as empty. Null keys are written as ``null`` and read back as null.
Equal payloads of at least ``least_bytes`` bytes: the record with the largest key is the response, others revisit it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_RECORDS = 2000
#: Fields of a record's header line by archive version (fixed by the format).
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}
PARSED = "key long, uri string, date string, type string, payload string, payload_bytes long, payload_digest string, record_id string"


def _text_files(rows: DataFrame, path: str, separator: str) -> None:
    (rows.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", separator)
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", version: int | None = None) -> None:
    """Pages as ARC records; ``version`` None takes version 1 for even keys and 2 for odd ones, which a reader must tell apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for k, address, html in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                size = len((html or "").encode())
                uri = quote(address or "about:blank", safe="%/:=&?~#+!$,;'@()*[]") + f"#key={'null' if k is None else k}"
                v = version or (1 if (k or 0) % 2 == 0 else 2)
                day = f"2001{1 + (k or 0) % 12:02d}{1 + (k or 0) % 28:02d}000000"
                middle = "" if v == 1 else "200 - - 0 pages.arc "
                lines.append(f"{uri} 0.0.0.0 {day} text/html {middle}{size}\n{html or ''}")
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    rows = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(payload).cast("string"))
    _text_files(rows.mapInArrow(run, "value string"), path, "\n")


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of each record of one uncompressed ARC file; the version block is skipped."""
    at = 0
    while at < len(content):
        end = content.index(b"\n", at)
        fields = content[at:end].decode().rstrip("\r").split(" ")
        names = next((n for n in ARC_FIELDS.values() if len(n) == len(fields)), None)
        if names is None:
            raise ValueError(f"an ARC header line has {len(fields)} fields")
        header = dict(zip(names, fields))
        start, size = end + 1, int(header["length"])
        if start + size > len(content):
            raise ValueError(f"the record {header['url']} is cut off")
        if not header["url"].startswith("filedesc:"):
            yield header, content[start : start + size]
        at = start + size + 1


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def _key_of(uri: str) -> int | None:
    found = uri.rpartition("#key=")[2]
    return None if found == "null" else int(found)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder of ARC files with what their WARC records need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for header, payload in arc_records(gzip.decompress(content.as_py())):
                    d, made = digest(payload), header["date"]
                    date = f"{made[:4]}-{made[4:6]}-{made[6:8]}T{made[8:10]}:{made[10:12]}:{made[12:14]}Z"
                    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{header['url']} {made} {d}")
                    rows.append((_key_of(header["url"]), header["url"], date, header["type"], payload.decode("utf-8", "replace"), len(payload), d, f"urn:uuid:{rid}"))
                if rows:
                    names = [c.split(" ")[0] for c in PARSED.split(", ")]
                    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in PARSED.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return _files(spark, path).mapInArrow(run, PARSED)


def write_warc(records: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Records as WARC files, equal payloads stored once. Only digests and keys are grouped; payloads move once."""
    firsts = (records.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
              .agg(F.count("*").alias("n"), F.max("key").alias("first_key"), F.max_by(F.struct("uri", "record_id", "date"), "key").alias("first"))
              .where("n > 1").select(F.col("payload_digest").alias("d"), "first_key", "first"))
    joined = records.join(firsts, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") >= least_bytes), "left")
    revisit = F.col("d").isNotNull() & F.col("first_key").isNotNull() & ~F.col("key").eqNullSafe(F.col("first_key"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    shared = F.concat(line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("uri")),
                      line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), line("Content-Type", F.col("type")))
    response = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response"), shared, line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n\r\n"), "payload")
    again = F.concat(F.lit("WARC/1.1\r\nWARC-Type: revisit"), shared,
                     line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                     line("WARC-Refers-To", F.concat(F.lit("<"), "first.record_id", F.lit(">"))), line("WARC-Refers-To-Date", F.col("first.date")),
                     line("WARC-Refers-To-Target-URI", F.col("first.uri")), line("X-Payload-Length", F.col("payload_bytes").cast("string")),
                     line("Content-Length", F.lit("0")), F.lit("\r\n\r\n"))
    _text_files(joined.select(F.when(revisit, again).otherwise(response).alias("value")), path, "\r\n\r\n")


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content) of each record of one uncompressed WARC file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        body = content[end + 4 : end + 4 + size]
        if len(body) < size:
            raise ValueError(f"the record {headers['WARC-Record-ID']} is cut off")
        yield headers, body
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record, its digest checked against its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, body in warc_records(gzip.decompress(content.as_py())):
                    again = headers["WARC-Type"] == "revisit"
                    d = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not again and digest(body) != d:
                        raise ValueError(f"the digest of {headers['WARC-Record-ID']} does not fit its content")
                    rows.append((_key_of(headers["WARC-Target-URI"]), int(headers["X-Payload-Length"]) if again else len(body), d, headers["WARC-Type"],
                                 _key_of(headers["WARC-Refers-To-Target-URI"]) if again else None, headers["WARC-Record-ID"].strip("<>"), headers["WARC-Date"]))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date")
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], list(names))

    return _files(spark, path).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string")
