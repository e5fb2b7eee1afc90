"""Content-addressed WARC archive: payloads stored once by strong digest, record headers beside them.

An archive is a folder with two tables:

* ``payloads``: sha256, gzip-compressed payload, once per distinct payload;
* ``headers``: the exact header bytes of every record, and the sha256 of its payload.

``read_archive`` joins them on the digest, checks every payload against both digests, and gives whole records.
Payload bytes are compressed before they are shuffled, and copies collapse in the map tasks, so a payload that
most pages share is no hot key on the way in; on the way out adaptive execution splits its headers.

Edge cases: a null payload is empty; an empty payload is a payload like any other.  Null URLs give an empty
target.  Null ids sort last and are written as an empty id.  Rows that repeat an id and a payload are records
of their own; those with the smallest id are all responses.  Line breaks in a URL are percent-encoded, since
a header is one line per field.  An empty table gives an empty archive.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = b"\r\n\r\n"
#: Date of records whose time of capture is not given.
UNDATED = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1, as in WARC-Payload-Digest."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _payload_of(batch: pa.RecordBatch):
    for value in batch.column("payload"):
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def _digests(batches):
    for batch in batches:
        strong, named, sizes = [], [], []
        for payload in _payload_of(batch):
            strong.append(hashlib.sha256(payload).hexdigest())
            named.append(payload_digest(payload))
            sizes.append(len(payload))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(strong, pa.string()), pa.array(named, pa.string()), pa.array(sizes, pa.int64())],
            ["page_id", "url", "sha256", "digest", "n_bytes"])


def _packed(batches):
    for batch in batches:
        for at in range(0, len(batch), 512):
            payloads = list(_payload_of(batch.slice(at, 512)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([zlib.compress(p, 6) for p in payloads], pa.binary())],
                ["sha256", "packed"])


def record_header(page_id, url: str | None, kind: str, digest: str, refers_to, length: int, date: str = UNDATED) -> bytes:
    """Bytes of a record before its payload, without the blank line that ends them: WARC fields and HTTP head.

    The HTTP head gives the length of the payload, which a revisit does not repeat.
    """
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\n" in (url or "") or "\r" in (url or "") else url or ""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = len(http) + len(END) + (0 if kind == "revisit" else length)
    return "\r\n".join([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {block}", "", http]).encode()


def _headers(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            first = r["page_id"] is None and r["first_id"] is None or r["page_id"] is not None and r["page_id"] == r["first_id"] or r["n_bytes"] < r["least"]
            out.append(record_header(r["page_id"], r["url"], "response" if first else "revisit", r["digest"], r["first_id"], r["n_bytes"], r["date"]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.binary()), batch.column("sha256")], ["page_id", "header", "sha256"])


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = UNDATED) -> None:
    """Write the two tables of an archive; payloads below ``least_bytes`` are never referred to.

    ``date`` is the time of capture of all records, as WARC-Date gives it.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode("html", "UTF-8").alias("payload"))
    id_type = rows.schema["page_id"].dataType.simpleString()
    seen = rows.mapInArrow(_digests, f"page_id {id_type}, url string, sha256 string, digest string, n_bytes bigint")
    firsts = seen.groupBy("sha256").agg(F.min("page_id").alias("first_id"))
    (seen.join(firsts, "sha256").withColumn("least", F.lit(least_bytes).cast("bigint")).withColumn("date", F.lit(date))
     .mapInArrow(_headers, f"page_id {id_type}, header binary, sha256 string").write.parquet(f"{folder}/headers"))
    (rows.select("payload").mapInArrow(_packed, "sha256 string, packed binary")
     .groupBy("sha256").agg(F.first("packed").alias("packed")).write.parquet(f"{folder}/payloads"))


def _restored(batches):
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            payloads = [zlib.decompress(p) for p in part.column("packed").to_pylist()]
            for payload, want in zip(payloads, part.column("sha256").to_pylist()):
                if hashlib.sha256(payload).hexdigest() != want:
                    raise ValueError(f"payload {want} does not match its digest")
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("header"), pa.array(payloads, pa.binary())], ["page_id", "header", "payload"])


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, header and payload of every record, each payload checked against its strong digest."""
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    id_type = headers.schema["page_id"].dataType.simpleString()
    return headers.join(payloads, "sha256").mapInArrow(_restored, f"page_id {id_type}, header binary, payload binary")


def parse_header(header: bytes) -> dict[str, str]:
    """Values of the WARC fields by lower-cased name; of the HTTP head, the payload's length as ``payload-length``."""
    named, _, http = header.partition(END)
    fields = {"payload-length": http.decode().rsplit(" ", 1)[-1], "http-length": str(len(http) + len(END))}
    for line in named.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.lower()] = value.strip()
    return fields


def record_fields(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as the records say; digests are recomputed."""
    id_type = records.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sizes, digests, kinds, refers = [], [], [], []
            for header, payload in zip(batch.column("header").to_pylist(), _payload_of(batch)):
                fields = parse_header(header)
                digest = payload_digest(payload)
                block = int(fields["http-length"]) + (0 if fields["warc-type"] == "revisit" else len(payload))
                if (fields["warc-payload-digest"], fields["payload-length"], fields["content-length"]) != (f"sha1:{digest}", str(len(payload)), str(block)):
                    raise ValueError(f"record {fields['warc-record-id']} does not match its payload")
                to = fields.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                sizes.append(len(payload))
                digests.append(digest)
                kinds.append(fields["warc-type"])
                refers.append(to or None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), pa.array(refers, pa.string())],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    out = records.mapInArrow(run, f"page_id {id_type}, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return out.withColumn("refers_to", F.col("refers_to").cast(id_type))


def record_bytes(records: DataFrame) -> DataFrame:
    """page_id and the whole record: headers, blank line, payload (none in a revisit) and the two line breaks that end it."""
    end = F.lit(END)
    again = F.startswith(F.col("header"), F.lit(b"WARC/1.1\r\nWARC-Type: revisit"))
    payload = F.when(again, F.lit(b"")).otherwise(F.col("payload"))
    return records.select("page_id", F.concat("header", end, payload, end).alias("record"))
