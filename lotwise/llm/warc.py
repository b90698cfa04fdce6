"""Operator 3: WARC archives with segmented records and chunked payloads, written and read back.

Writing: of equal payloads the page with the smallest page_id becomes a response record whose block is an HTTP message
with chunked transfer framing; the others become revisit records that refer to it. Blocks longer than `segment_bytes` are
split into continuation records. Reading: segments are grouped by origin identifier, ordered by number, their total length
is verified, the chunked framing is decoded, and lengths and digests are recomputed from the payload itself.

Records have names of their own and carry page_id as a field, so page_ids need not be unique: every row gives one row.
Rows of equal page_id and payload are told apart by url, then not at all: any one of them is the response, and the others
revisit it. Null page_ids come after all others. Null html is an empty payload, of very long html every byte is kept (a
page takes memory in proportion to its length); a null url gives a URN; an empty table gives no rows; extra columns are
ignored. Damaged records raise an error that names the record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import Scratch, read_table

SEGMENT_BYTES, CHUNK_BYTES = 16_384, 4_096
#: Records in one archive at most, so that an archive has at most RECORDS * SEGMENT_BYTES bytes and fits a task.
RECORDS = 4_000
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
END = b"\r\n\r\n"
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Payload in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(framed: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped, a cut body is an error."""
    at, out = 0, []
    while True:
        line = framed.index(b"\r\n", at)
        n = int(framed[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        at = line + 2 + n
        if framed[at : at + 2] != b"\r\n":
            raise ValueError(f"chunk of {n} bytes isn't closed")
        out.append(framed[line + 2 : at])
        at += 2


def record(kind: str, name: str, fields: dict[str, object], block: bytes) -> bytes:
    """One WARC record without its closing blank lines, which the writer puts between records."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{name}>", "WARC-Date": DATE, **fields, "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + block


def response_records(name: str, page_id: int | None, url: str | None, payload: bytes, segment_bytes: int) -> Iterator[bytes]:
    """The record of a page's payload, in segments where its block is long."""
    block = HTTP + chunked(payload)
    fields = _fields(name, page_id, url, digest(payload))
    cuts = range(0, len(block), segment_bytes)
    for number, at in enumerate(cuts, 1):
        part = block[at : at + segment_bytes]
        if number == 1:
            yield record("response", name, fields | {"WARC-Segment-Number": 1 if len(cuts) > 1 else None}, part)
        else:
            last = {"WARC-Segment-Total-Length": len(block) if number == len(cuts) else None}
            yield record("continuation", f"{name}:{number}", {"WARC-Segment-Origin-ID": f"<urn:{name}>", "WARC-Segment-Number": number, **last}, part)


def revisit_record(name: str, page_id: int | None, url: str | None, payload_digest: str, target: str) -> bytes:
    return record("revisit", name, _fields(name, page_id, url, payload_digest) | {"WARC-Refers-To": f"<urn:{target}>", "WARC-Profile": SAME}, HTTP)


def _fields(name: str, page_id: int | None, url: str | None, payload_digest: str) -> dict[str, object]:
    uri = re.sub(r"\s", "%20", url) if url else f"urn:{name}"
    return {"WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{payload_digest}", "Content-Type": "application/http; msgtype=response", "Page-ID": page_id}


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id (long), url, html, _sum (hexadecimal SHA-1 of the payload), _n (its bytes)."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html).alias("_sum"), F.octet_length(html).alias("_n"))


def _rank() -> Column:
    """Which of equal payloads is the response: the smallest page_id, null ones last, then the smallest url."""
    return F.struct(F.col("page_id").isNull().alias("unknown"), F.col("page_id").alias("page_id"), F.col("url").alias("url"))


def shared_payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, html): one row per distinct payload.

    Equal payloads are merged before the shuffle, so one that a third of all pages share is no hot group.
    """
    first = _keyed(pages).groupBy("_sum").agg(F.min_by(F.struct("page_id", "url", "html"), _rank()).alias("first"))
    return first.select("first.*")


def revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, url, _sum) of every row but one of each payload, which is that of shared_payloads().

    Equal rows are counted by scan partition, so a count is no larger than a partition; one is taken from the least of
    each payload. Only digests, ids and urls are shuffled.
    """
    counted = _keyed(pages).groupBy("_sum", "page_id", "url", F.spark_partition_id().alias("_part")).agg(F.count("*").alias("_rows"))
    counted = scratch.save(counted, "payload-rows")
    rank = F.struct(_rank().alias("rank"), F.col("_part"))
    first = scratch.save(counted.groupBy("_sum").agg(F.min(rank).alias("_first"), F.sum("_rows").alias("_all")).where("_all > 1"), "payloads")
    left = counted.join(first, "_sum").withColumn("_rows", F.col("_rows") - F.when(rank == F.col("_first"), 1).otherwise(0)).where("_rows > 0")
    return left.select("page_id", "url", "_sum", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_copy")).drop("_copy")


def write_warc(pages: DataFrame, path: str, scratch: Scratch, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write pages (page_id, url, html) as gzip-compressed WARC archives under path.

    Payloads of fewer than min_bytes are not compared: each is a response.
    """
    large = pages if min_bytes <= 0 else pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes)

    def flush(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    def responses(named: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = _names("page")
            for b in batches:
                held, size = [], 0
                for page_id, url, html in zip(*(c.to_pylist() for c in b.columns)):
                    payload = (html or "").encode()
                    for r in response_records(f"sha1:{digest(payload)}" if named else next(names), page_id, url, payload, segment_bytes):
                        held.append(r)
                        size += len(r)
                    if size > 1 << 24:
                        yield flush(held)
                        held, size = [], 0
                yield flush(held)

        return run

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names("revisit")
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns))
            sums = ((page_id, url, base64.b32encode(bytes.fromhex(x)).decode()) for page_id, url, x in rows)
            yield flush([revisit_record(next(names), page_id, url, x, f"sha1:{x}") for page_id, url, x in sums])

    made = shared_payloads(large).mapInArrow(responses(True), "record binary")
    made = made.unionByName(revisits(large, scratch).mapInArrow(again, "record binary"))
    if min_bytes > 0:
        small = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) < min_bytes)
        made = made.unionByName(small.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(responses(False), "record binary"))
    writer = made.select(F.col("record").cast("string")).write.mode("overwrite").option("lineSep", END.decode()).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS).text(path)


def _names(kind: str) -> Iterator[str]:
    """Names that no other task of the job gives: by partition and count."""
    part = TaskContext.get().partitionId()
    return (f"{kind}:{part}:{k}" for k in itertools.count())


def parse(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record, by content length."""
    while version := archive.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record where one should start: {version[:40]!r}")
        fields = {}
        while (line := archive.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        block = archive.read(n := int(fields["content-length"]))
        if len(block) != n or archive.read(4) != END:
            raise ValueError(f"record {fields.get('warc-record-id')} is cut")
        yield fields, block


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message, without transfer framing."""
    head, _, body = block.partition(END)
    return dechunk(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


_PARSED = "name string, page_id long, kind string, target string, number int, total long, payload_bytes long, payload_digest string, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of _PARSED: whole records with their payload's length and digest, segments with their block.

    A segment's name is that of its origin; an archive has at most RECORDS records of SEGMENT_BYTES, so it fits a task.
    """
    names = [x.split()[0] for x in _PARSED.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def row(f: dict[str, str], block: bytes) -> tuple:
        kind, number, page_id = f["warc-type"], f.get("warc-segment-number"), f.get("page-id")
        own = (f.get("warc-segment-origin-id") or f["warc-record-id"], int(page_id) if page_id else None, kind)
        if kind == "revisit":
            return *own, f["warc-refers-to"], None, None, None, f["warc-payload-digest"].removeprefix("sha1:"), None
        if number is None:
            payload = payload_of(block)
            return *own, None, None, None, len(payload), digest(payload), None
        total = f.get("warc-segment-total-length")
        return *own, None, int(number), int(total) if total else None, None, None, block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for f, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    rows.append(row(f, block))
                    size += len(rows[-1][-1] or b"")
                    if size > 1 << 24 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, _PARSED)


def reassemble(segments: DataFrame) -> DataFrame:
    """(name, page_id, payload_bytes, payload_digest) of records that were split; each group is one record's segments."""
    parts = F.sort_array(F.collect_list(F.struct("number", "block")))
    grouped = segments.groupBy("name").agg(F.max("page_id").alias("page_id"), parts.alias("parts"), F.max("total").alias("total"))
    schema = "name string, page_id long, payload_bytes long, payload_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sums = [], []
            for name, parts, total in zip(b.column(0), b.column(2), b.column(3)):
                parts = parts.as_py()
                block = b"".join(p["block"] for p in parts)
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != total.as_py():
                    raise ValueError(f"segments of record {name} don't add up to {total} bytes")
                payload = payload_of(block)
                n.append(len(payload))
                sums.append(digest(payload))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sums, pa.string())], names=["name", "page_id", "payload_bytes", "payload_digest"])

    return grouped.mapInArrow(run, schema)


def read_warc(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, from the archives under path.

    A revisit's length is that of the record that it refers to, whose digest must be the same. The join to it is one that
    Spark can split where very many records revisit one.
    """
    parsed = scratch.save(read_records(spark, path), "parsed")
    whole = parsed.where("kind = 'response' and number is null").select("name", "page_id", "payload_bytes", "payload_digest")
    split = reassemble(parsed.where("number is not null").select("name", "page_id", "number", "block", "total"))
    response = scratch.save(whole.unionByName(split), "responses")
    revisit = parsed.where("kind = 'revisit'").select("page_id", "target", "payload_digest")
    found = response.select(F.col("name").alias("target"), F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("_own"))
    other = F.raise_error(F.concat(F.lit("revisit of another payload: "), F.col("target"))).cast("long")
    followed = revisit.join(found, "target", "left").withColumn("payload_bytes", F.when(F.col("_own") == F.col("payload_digest"), F.col("payload_bytes")).otherwise(other))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = response.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).select(columns)
    return own.unionByName(followed.withColumn("record_type", F.lit("revisit")).select(columns))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), f"{scratch.root}/archives", scratch)
    return read_warc(spark, f"{scratch.root}/archives", scratch)
