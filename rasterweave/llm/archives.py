"""WARC archives of a table of pages: written by Spark as files of records, and read back.

Each page is a record whose block is an HTTP response with the payload in chunked
transfer framing. Blocks longer than SEGMENT bytes are cut: the first part is a response
with segment number 1, the others are continuation records that name its identifier as
their origin, and the last one tells the total length. Of pages with equal payloads of
MIN_REVISIT bytes or more, the one with the smallest id is a response and the others are
revisit records, which name it and hold no payload.

Archives are text files in Spark's sense: each row is one record and the line separator
is the two line breaks that end a record, so they are written to any file system that
Spark knows; the number of records in a file is limited, and with it, as a record is at most a segment, the
size of a file. They are read with the version line as separator. That line never stands
inside a record: chunks of the framing end within each copy of it in a payload, and line
breaks in an address are percent-encoded.

Read back, continuation records are grouped by the identifier of their origin and put in
order of their number; the numbers must be whole, and the length the one told, as must
each record's own and each payload's digest, else the page is returned with ``intact`` false and without payload.
Records in one part are not shuffled. A page, as a row of the table, must fit a task.

NULL payloads are empty. Pages without an id are records without one; a payload that
only such pages share has no revisits. Of rows that repeat id and payload one is the response and
the others revisit it. An empty table gives an archive without records.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterweave.llm.ranks import hot_join
from rasterweave.sources.settle import forget, settle, shared_folder

# --- fixed values: the format's own names -----------------------------------
VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
# ----------------------------------------------------------------------------
MIN_REVISIT = 100
CHUNK = 4096
SEGMENT = 16_384
FILE_RECORDS = 8_192
DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing; no version line stands in it."""
    cuts = set(range(0, len(payload), size))
    name = VERSION.rstrip()
    at = payload.find(name)
    while at >= 0:
        cuts.add(at + 1)
        at = payload.find(name, at + 1)
    bounds = [*sorted(cuts), len(payload)]
    parts = [b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    parts, at = [], 0
    while True:
        line = framed.find(b"\r\n", at)
        try:
            size = int(framed[at:line].split(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return None
        if size == 0:
            return b"".join(parts)
        at = line + 2 + size
        if framed[at : at + 2] != b"\r\n":
            return None
        parts.append(framed[line + 2 : at])
        at += 2


def _record(kind: str, identifier: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    digest = hashlib.sha256(block).hexdigest()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{identifier}>"), ("WARC-Date", DATE), *fields,
            ("WARC-Block-Digest", f"sha256:{digest}"), ("Content-Length", len(block))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head if value is not None)
    return VERSION + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block


def _address(url: str | None) -> str | None:
    if url is None:
        return None
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    return f"{url[:-1]}%31" if url.endswith("WARC/1.1") else url


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[bytes] = []
        for row, page, url, payload, digest in zip(*[batch.column(i) for i in range(5)]):
            row, page, url = row.as_py(), page.as_py(), url.as_py()
            origin = f"urn:page:{row}"
            block = HTTP + chunked(payload.as_py())
            parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
            fields = [("Page-ID", page), ("WARC-Target-URI", _address(url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
                      ("Content-Type", "application/http; msgtype=response")]
            if len(parts) > 1:
                fields.append(("WARC-Segment-Number", 1))
            out.append(_record("response", origin, fields, parts[0]))
            for number, part in enumerate(parts[1:], 2):
                last = number == len(parts)
                out.append(_record("continuation", f"{origin}:{number}", [
                    ("WARC-Target-URI", _address(url)), ("WARC-Segment-Number", number), ("WARC-Segment-Origin-ID", f"<{origin}>"),
                    ("WARC-Segment-Total-Length", len(block) if last else None),
                ], part))
            if sum(map(len, out)) > SEGMENT * 64:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def _revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row, page, url, digest, first in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            out.append(_record("revisit", f"urn:page:{row}", [
                ("Page-ID", page), ("WARC-Target-URI", _address(url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
                ("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", PROFILE),
            ], b""))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write the pages as gzipped WARC files below ``path``."""
    stored = settle(
        pages.select(
            F.monotonically_increasing_id().alias("row"), F.col(page_id).cast("bigint").alias("page"),
            F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
        ).withColumn("digest", F.sha2("payload", 256))
    )
    long = stored.filter(F.octet_length("payload") >= MIN_REVISIT).select("row", "page", "url", "digest")
    # One row per shared payload: the smallest id, and of its rows the first.
    shared = (
        long.groupBy("digest").agg(F.min(F.when(F.col("page").isNotNull(), F.struct("page", "row"))).alias("f"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and f is not null").select("digest", F.col("f.row").alias("first"))
    )
    again = settle(hot_join(long, shared, "digest").filter("row <> first").select("row", "page", "url", "digest", "first"))
    kept = stored.join(again.select("row"), "row", "left_anti").select("row", "page", "url", "payload", "digest")
    records = kept.mapInArrow(_responses, "record binary").union(again.mapInArrow(_revisits, "record binary"))
    # Spark's strings are bytes: nothing is decoded or changed on the way.
    (
        records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END)
        .option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    )
    forget(stored, again)


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("kind", pa.string()), ("id", pa.string()), ("page", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
        ("number", pa.int64()), ("origin", pa.string()), ("total", pa.int64()), ("refers_to", pa.string()),
        ("block", pa.binary()), ("whole", pa.bool_()),
    ])
    for batch in batches:
        rows = []
        for record in batch.column(0):
            head, _, rest = record.as_py().partition(b"\r\n\r\n")
            told = {}
            for line in head.split(b"\r\n"):
                name, _, value = line.partition(b":")
                told[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
            size = int(told.get("content-length", "-1")) if told.get("content-length", "").isdigit() else -1
            block = rest[: max(size, 0)]
            whole = len(block) == size and rest[size:] == b"\r\n\r\n"
            if whole and "warc-block-digest" in told:
                whole = told["warc-block-digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
            number = {n: int(told[n]) if told.get(n, "").lstrip("-").isdigit() else None for n in ("page-id", "warc-segment-number", "warc-segment-total-length")}
            rows.append({
                "kind": told.get("warc-type"), "id": told.get("warc-record-id", "").strip("<>"), "page": number["page-id"],
                "url": told.get("warc-target-uri"), "digest": told.get("warc-payload-digest", "").removeprefix("sha256:"),
                "number": number["warc-segment-number"], "origin": told.get("warc-segment-origin-id", "").strip("<>"),
                "total": number["warc-segment-total-length"], "refers_to": told.get("warc-refers-to", "").strip("<>"),
                "block": block, "whole": whole,
            })
        yield pa.RecordBatch.from_pylist(rows, schema)


@F.arrow_udf(T.BinaryType())
def _payload(block: pa.Array) -> pa.Array:
    """What an HTTP response holds, without its framing; NULL if that is broken."""
    out = []
    for b in block:
        head, found, body = (b.as_py() or b"").partition(b"\r\n\r\n")
        if b"transfer-encoding: chunked" in head.lower():
            out.append(unchunked(body))
        else:
            out.append(body if found else None)
    return pa.array(out, pa.binary())


def read_records(spark: SparkSession, path: str, segments: bool | None = None) -> DataFrame:
    """One row per record of the archives below ``path``; ``whole`` tells whether length and digest are right.

    ``segments`` keeps only records that are segments, or only those that are not.
    """
    pieces = spark.read.schema("value string").option("lineSep", VERSION.decode()).text(path).filter("value <> ''")
    if segments is not None:
        head = F.lower(F.substring_index("value", END, 1))
        pieces = pieces.filter(F.contains(head, F.lit("\r\nwarc-segment-number:")) == segments)
    return pieces.select(F.col("value").cast("binary")).mapInArrow(
        _fields,
        "kind string, id string, page bigint, url string, digest string, number bigint, origin string, total bigint, "
        "refers_to string, block binary, whole boolean",
    )


def reassembled(spark: SparkSession, path: str) -> DataFrame:
    """Of the archives below ``path``, (id, kind, page, url, digest, refers_to, payload, intact) of each page, its segments put together; revisits have no payload."""
    told = ("kind", "page", "url", "digest", "refers_to")
    one = read_records(spark, path, False).filter("kind in ('response', 'revisit')").select("id", *told, "block", F.col("whole").alias("intact"))
    first = F.col("kind") == "response"
    many = (
        read_records(spark, path, True).filter("kind in ('response', 'continuation')")
        .groupBy(F.when(first, F.col("id")).otherwise(F.col("origin")).alias("id")).agg(
            *[F.max(F.when(first, F.col(c))).alias(c) for c in told],
            F.max("total").alias("total"), F.every("whole").alias("whole"),
            F.array_sort(F.collect_list(F.struct("number", "block"))).alias("s"),
        )
        .withColumn("block", F.aggregate("s", F.lit(b""), lambda done, x: F.concat(done, x["block"])))
        .withColumn("numbers", F.transform("s", lambda x: x["number"]))
        .select("id", *told, "block", (
            F.col("whole") & (F.octet_length("block") == F.col("total"))
            & (F.col("numbers") == F.sequence(F.lit(1).cast("bigint"), F.size("s").cast("bigint")))
        ).alias("intact"))
    )
    read = one.unionByName(many).withColumn("payload", _payload.asNondeterministic()("block")).drop("block")
    right = (F.col("kind") == "revisit") | (F.sha2("payload", 256) == F.col("digest"))
    intact = F.coalesce(F.col("intact") & right, F.lit(False))
    return read.withColumn("intact", intact).withColumn("payload", F.when(F.col("intact"), F.col("payload")))


def digest(pages: DataFrame) -> DataFrame:
    """Each page's payload size and digest, kind of record and what it refers to, from archives written and read back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    found = settle(reassembled(spark, path).select(
        "id", "kind", "page", "refers_to",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
    ))
    responses = found.filter("kind = 'response'")
    again = found.filter("kind = 'revisit'").select(F.col("page").alias("page_id"), F.col("refers_to").alias("id"))
    held = responses.select("id", "page", "payload_bytes", "payload_digest")
    revisits = hot_join(again, held, "id", "left").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("page").alias("refers_to")
    )
    return revisits.union(responses.select(
        F.col("page").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.lit(None).cast("bigint"),
    ))
