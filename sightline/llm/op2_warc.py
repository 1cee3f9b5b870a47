"""WARC archives: writing captures, reading them back, and assembling transactions.

Writing. Each page becomes a request, a response (or a revisit) and a metadata record; the first and the last name the
second in WARC-Concurrent-To. Pages with equal payloads of at least MIN_PAYLOAD bytes are written once, as the response of
the smallest id; the others are revisits that refer to it. Records are packed into archives of about ARCHIVE_BYTES, one
archive per file, written and committed by Spark's own text writer, gzipped; a lost task is simply run again.

Reading. Whole archives are read as binary files (their size is bounded when written), unpacked and cut into records by
their Content-Length, so a payload may hold anything.

Assembly. Records are joined through concurrent-to identifiers, whichever side names the other: to the response they name
or are named by, or over one more record (metadata that names the request that the response names). Each response or
revisit becomes one nested row with its request and metadata records. The joins are on record ids, which are unique;
payloads are not shuffled. A revisit gets length and digest of the full payload from the response it refers to: one
response may be referred to by a third of all pages, which the adaptive skew join cuts up.

Defined results: a null html is an empty payload. Rows that repeat an id and a payload write the same record ids; each
still gives its own row, with the requests and metadata of both. A null id is written as no id, is read back as null and
never makes other pages revisits while a page with an id has the payload. Null urls give an empty target. Only id, url and
payload columns are read. An empty table writes no record and reads back as an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import batches, cut_lineage, small_batches

MIN_PAYLOAD, ARCHIVE_BYTES = 100, 8_000_000
#: Fixed values of the format.
VERSION, EOL = b"WARC/1.1", b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "2024-01-01T00:00:00Z"
PAGE_HEADER = "WARC-Page-ID"  # an extension field: the id of the row a record was written from

RECORD = "record_id string, record_type string, concurrent_to array<string>, refers_to string, target string, page_id {kind}, " \
         "payload_bytes long, payload_digest string, payload binary"


def record_id(role: str, page_id, digest: str) -> str:
    h = hashlib.sha256(f"{role}|{page_id}|{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def pack(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record. Line breaks in header values would end the header, so they are written as spaces."""
    head = [VERSION, *(f"{k}: {' '.join(v.splitlines())}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return EOL.join([*head, b"", b""]) + block + EOL + EOL


def unpack(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case name -> values) and block of each record."""
    at = 0
    while at < len(data):
        if data.startswith(EOL, at):
            at += 2
            continue
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(EOL + EOL, at)
        headers: dict[str, list[str]] = {}
        for line in data[at:end].split(EOL)[1:]:
            name, _, value = line.partition(b":")
            headers.setdefault(name.decode().strip().lower(), []).append(value.decode().strip())
        size = int(headers["content-length"][0])
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size


def with_originals(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(page_id, digest, size, first): first is the smallest id with the payload, null if it is too short to matter."""
    raw = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).alias("size"))
    return rows.where(F.col("size") >= MIN_PAYLOAD).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   revisits: bool = True) -> None:
    """Write `pages` as WARC archives below `path`. revisits: write equal payloads once."""
    raw = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                        raw.alias("payload"), F.sha2(raw, 256).alias("digest"))
    if revisits:
        # Only payloads that occur more than once are in this table; it is written first, so its size is known.
        known = cut_lineage(with_originals(pages, id_col, payload_col), "warc-originals")
        rows = rows.join(known.withColumn("again", F.lit(True)), "digest", "left")
        again = F.coalesce("again", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
        rows = rows.select("page_id", "url", "payload", "digest", F.when(again, F.col("first")).alias("first"), again.alias("is_revisit"))
    else:
        rows = rows.select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("first"), F.lit(False).alias("is_revisit"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            for page, url, payload, digest, first, again in zip(*[c.to_pylist() for c in part.columns], strict=True):
                for record in _records(page, url, payload, digest, first, again):
                    held.append(record)
                    size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    # Each row is one archive and each file takes one row. The writer ends it with a line end, which readers skip.
    (small_batches(rows).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
     .write.mode("overwrite").option("maxRecordsPerFile", 1).option("lineSep", "\r\n").option("compression", "gzip").text(path))


def _records(page, url: str, payload: bytes, digest: str, first, again: bool) -> list[bytes]:
    own = record_id("capture", page, digest)
    base = [("WARC-Date", WARC_DATE), ("WARC-Target-URI", url)] + ([] if page is None else [(PAGE_HEADER, str(page))])
    capture = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", own), *base,
               ("WARC-Payload-Digest", f"sha256:{digest}")]
    if again:
        capture += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id("capture", first, digest))]
        payload = b""
    else:
        capture += [("Content-Type", "text/html")]
    aside = [("WARC-Concurrent-To", own), *base]
    return [
        pack([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page, digest)), *aside,
              ("Content-Type", "application/http; msgtype=request")], f"GET {' '.join(url.split())} HTTP/1.1\r\n\r\n".encode()),
        pack(capture, payload),
        pack([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page, digest)), *aside,
              ("Content-Type", "application/warc-fields")], b"fetchTimeMs: 0\r\n"),
    ]


def read_archives(spark: SparkSession, path: str, page_type: str = "bigint", payload: bool = True) -> DataFrame:
    """A row per record below `path`: RECORD. payload: whether to return the blocks and not only length and digest."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())),
                        ("refers_to", pa.string()), ("target", pa.string()), ("page_id", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def rows(data: bytes) -> Iterator[tuple]:
        for h, block in unpack(data):
            one = {k: v[0] for k, v in h.items()}
            yield (one.get("warc-record-id"), one.get("warc-type"), h.get("warc-concurrent-to", []), one.get("warc-refers-to"),
                   one.get("warc-target-uri"), one.get(PAGE_HEADER.lower()), len(block), hashlib.sha256(block).hexdigest(),
                   block if payload else None)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for data in part.column(0):
                yield from batches(rows(zlib.decompress(data.as_py(), 47)), schema, 1000)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    out = small_batches(files).mapInArrow(run, RECORD.format(kind="string"))
    return out.withColumn("page_id", F.col("page_id").cast(page_type))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture, record_type, page_id, target, payload_bytes, payload_digest, refers_to, requests,
    metadata). requests and metadata: arrays of (record_id, payload_digest). Records without a capture give no row.
    """
    captures = records.where(F.col("record_type").isin("response", "revisit"))
    named = records.select("record_id", F.explode("concurrent_to").alias("other")).where("record_id <> other")
    links = named.unionByName(named.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct()
    asides = records.where(F.col("record_type").isin("request", "metadata")).select("record_id")
    to = captures.select(F.col("record_id").alias("other")).distinct()
    near = cut_lineage(links.join(to, "other", "left_semi").join(asides, "record_id", "left_semi")
                       .groupBy("record_id").agg(F.min("other").alias("capture")), "warc-links")
    far = (links.join(asides, "record_id", "left_semi").join(near.select("record_id"), "record_id", "left_anti")
           .join(near.select(F.col("record_id").alias("other"), "capture"), "other")
           .groupBy("record_id").agg(F.min("capture").alias("capture")))
    aside = (records.join(near.unionByName(far), "record_id")
             .select("capture", "record_type", F.struct("record_id", "payload_digest").alias("r")).distinct()
             .groupBy("capture").agg(
                 F.sort_array(F.collect_list(F.when(F.col("record_type") == "request", F.col("r")))).alias("requests"),
                 F.sort_array(F.collect_list(F.when(F.col("record_type") == "metadata", F.col("r")))).alias("metadata")))
    return captures.select(F.col("record_id").alias("capture"), *[c for c in captures.columns if c not in ("record_id", "concurrent_to")]).join(
        aside, "capture", "left")


def resolve(captures: DataFrame) -> DataFrame:
    """Captures with payload length and digest of the full payload, and refers_to as the id of the page referred to."""
    to = captures.where(F.col("record_type") == "response").groupBy(F.col("capture").alias("refers_to")).agg(
        F.min("page_id").alias("to_page"), F.min("payload_bytes").alias("to_bytes"), F.min("payload_digest").alias("to_digest"))
    again = F.col("record_type") == "revisit"
    return captures.join(to, "refers_to", "left").select(
        "capture", "page_id", F.when(again, F.col("to_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("to_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.when(again, F.col("to_page")).alias("refers_to"),
        F.size(F.coalesce("requests", F.array().cast("array<struct<record_id:string,payload_digest:string>>"))).alias("n_requests"),
        F.size(F.coalesce("metadata", F.array().cast("array<struct<record_id:string,payload_digest:string>>"))).alias("n_metadata"))
