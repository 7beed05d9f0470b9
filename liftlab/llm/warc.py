"""WARC archives: segmented writing, and reading with segment reassembly.

Writing. A payload becomes an HTTP response in chunked transfer framing. Blocks
longer than ``segment_bytes`` are cut into a response record with segment number 1 and
continuation records that name its identifier; the last one carries the total
length. Of records with equal payloads (by SHA-1) of at least ``revisit_bytes``,
the one with the smallest page id holds the payload and the others are revisit
records. Files are written by Spark's text sink, one record per value with the
record separator between them, so a task that is lost leaves nothing behind.

Reading. Files are parsed record by record. Segments are grouped by the origin
identifier, ordered by number, checked to be complete and of the stated total
length, and joined; a group holds one payload. Then the HTTP head is taken off,
the chunked framing decoded, and the payload checked against its digest. What does
not hold is named in ``problem`` (null if all is well); the row stays.

Defined cases. A null payload is the empty payload. A null url leaves out the
target. Rows without an id are written without one and are always responses.
Repeated rows are written one by one with the same type; records have
identifiers of their own. An empty table writes no record and reads as empty.
Further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlab.llm.common import scratch_path, stored, table

SEGMENT_BYTES = 1 << 16
HTTP_CHUNK = 1 << 13
#: Records per file: with segments of at most SEGMENT_BYTES, a file is at most 1 GB and usually far less.
RECORDS_PER_FILE = 1 << 14
DATE = "1970-01-01T00:00:00Z"
VERSION = "WARC/1.1"
SEPARATOR = "\r\n\r\n"
_HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_YIELD_BYTES = 1 << 23


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = HTTP_CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    out = []
    for a in range(0, len(payload), size):
        part = payload[a:a + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are left out."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at:at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without the separator that follows it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(name: str, page_id: int | None, url: str | None, payload: bytes,
                 refers_to: int | None, segment_bytes: int = SEGMENT_BYTES,
                 http_chunk: int = HTTP_CHUNK) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response in segments."""
    target = None if url is None else urllib.parse.quote(url, safe="/:?#[]@!$&'()*+,;=%~")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("Page-ID", page_id),
              ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Payload-Length", len(payload))]
    if refers_to is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *common,
                      ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                      ("Refers-To-Page-ID", refers_to), ("Content-Type", "application/http; msgtype=response")],
                     _HTTP_HEAD + b"\r\n")
        return
    block = _HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, http_chunk)
    parts = [block[a:a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    several = len(parts) > 1
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *common,
                  ("Content-Type", "application/http; msgtype=response"),
                  ("WARC-Segment-Number", 1 if several else None)], parts[0])
    for i, part in enumerate(parts[1:], 2):
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{i}>"), ("WARC-Date", DATE),
                      ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", f"<{name}>"),
                      ("WARC-Segment-Number", i),
                      ("WARC-Segment-Total-Length", len(block) if i == len(parts) else None)], part)


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = 0,
                   records_per_file: int = RECORDS_PER_FILE, segment_bytes: int = SEGMENT_BYTES,
                   http_chunk: int = HTTP_CHUNK) -> None:
    """(page_id, url, payload: binary) -> gzip WARC files below ``path``."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                     F.coalesce("payload", F.lit(b"")).alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload"))
    # Who revisits whom is settled on narrow rows; only revisits are joined back.
    ids = stored(p.where(F.length("payload") >= revisit_bytes).select("page_id", "sha1"), "warc-digests")
    first = ids.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = ids.join(first, "sha1").where("page_id <> refers_to").select(
        "page_id", F.col("sha1").alias("_sha1"), "refers_to").distinct()
    p = p.join(again.withColumnRenamed("page_id", "_id"),
               (F.col("page_id") == F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left")
    run = scratch_path(pages.sparkSession, "run").rsplit("-", 1)[1]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            held, size = [], 0
            for page_id, url, payload, refers_to in zip(*(c for c in b.columns)):
                n += 1
                for r in page_records(f"urn:x-page:{run}.{part}.{n}", page_id.as_py(), url.as_py(),
                                      payload.as_py(), refers_to.as_py(), segment_bytes, http_chunk):
                    held.append(r)
                    size += len(r)
                if size > _YIELD_BYTES:
                    yield pa.record_batch([pa.array(held, pa.binary())], names=["value"])
                    held, size = [], 0
            if held:
                yield pa.record_batch([pa.array(held, pa.binary())], names=["value"])

    (p.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "value binary")
     .select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR)
     .option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower-cased names) and block of every record of a file."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        last = ""
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and last:  # a folded field goes on
                fields[last] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            fields["truncated-file"] = "yes"
        yield fields, block


_RECORD = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("url", pa.string()),
                     ("page_id", pa.int64()), ("refers_to", pa.int64()), ("origin", pa.string()),
                     ("number", pa.int64()), ("total", pa.int64()), ("stated_digest", pa.string()),
                     ("stated_bytes", pa.int64()), ("problem", pa.string()), ("block", pa.binary())])
_RECORD_DDL = ("record_id string, warc_type string, url string, page_id long, refers_to long, origin string, "
               "number long, total long, stated_digest string, stated_bytes long, problem string, block binary")


def _row(f: dict[str, str], block: bytes) -> tuple:
    def number(key: str) -> int | None:
        return int(f[key]) if f.get(key, "").lstrip("-").isdigit() else None

    return (f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), number("page-id"),
            number("refers-to-page-id"), f.get("warc-segment-origin-id"), number("warc-segment-number"),
            number("warc-segment-total-length"), f.get("warc-payload-digest"), number("payload-length"),
            "file ends within the record" if "truncated-file" in f else None, block)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the (gzip or plain) files below ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                raw = io.BytesIO(content.as_buffer())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content.as_buffer()[:2] == b"\x1f\x8b" else raw
                held, size = [], 0
                for fields, block in parse(stream):
                    held.append(_row(fields, block))
                    size += len(block)
                    if size > _YIELD_BYTES:
                        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held), _RECORD)], schema=_RECORD)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held), _RECORD)], schema=_RECORD)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, _RECORD_DDL)


def reassembled(records: DataFrame) -> DataFrame:
    """Segments of one origin as one row; other records as they are."""
    single = records.where(F.col("number").isNull() & F.col("origin").isNull()).select(
        *[c for c in records.columns if c not in ("origin", "number", "total")], F.lit(1).alias("segments"))
    part = records.where(F.col("number").isNotNull() | F.col("origin").isNotNull())
    origin = F.coalesce("origin", "record_id")
    first = F.col("origin").isNull()
    kept = ("record_id", "warc_type", "url", "page_id", "refers_to", "stated_digest", "stated_bytes")
    g = part.groupBy(origin.alias("_origin")).agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in kept],
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"), F.max("problem").alias("problem"))
    numbers = F.transform("parts", lambda p: p["number"])
    wanted = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: i.cast("long"))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.length(p["block"]))
    problem = F.coalesce(
        "problem", F.when(F.col("total").isNull(), "the last segment is missing"),
        F.when(F.coalesce(numbers != wanted, F.lit(True)), "segments are missing or repeated"),
        F.when(length != F.col("total"), "segments do not add up to the total length"))
    # Joined as text in one go: a running concat would copy what it has for every segment.
    block = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    return single.unionByName(g.select(
        F.coalesce("record_id", "_origin").alias("record_id"),
        F.coalesce("warc_type", F.lit("continuation")).alias("warc_type"), *kept[2:],
        problem.alias("problem"), block.alias("block"), F.size("parts").alias("segments")))


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response block."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("no end of the HTTP head")
    fields = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    coding = fields.get(b"transfer-encoding", b"").strip()
    return unchunked(body) if coding == b"chunked" else body


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest,
    segments, problem), one row per response and revisit."""
    whole = reassembled(read_records(spark, path))
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("segments", pa.int32()), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                stated, problem = (r["stated_digest"] or "").removeprefix("sha1:"), r["problem"]
                if r["warc_type"] == "revisit":
                    payload, size, sha = None, r["stated_bytes"], stated
                else:
                    try:
                        payload = payload_of(r["block"])
                    except (ValueError, zlib.error) as e:
                        payload, problem = b"", problem or f"the HTTP body cannot be decoded: {e}"
                    size, sha = len(payload), digest(payload)
                    if sha != stated:
                        problem = problem or "the payload does not match its digest"
                rows.append((r["record_id"], r["page_id"], r["url"], r["warc_type"], r["refers_to"], payload,
                             size, sha, r["segments"], problem))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return whole.mapInArrow(run, "record_id string, page_id long, url string, record_type string, refers_to long, "
                                 "payload binary, payload_bytes long, payload_digest string, segments int, "
                                 "problem string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select(
        "page_id", "url", F.col("html").cast("binary").alias("payload")), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                             "refers_to", "segments", "problem")


def oracle() -> str:
    """DuckDB: digests with base32 from the hexadecimal digits, eight letters per ten."""
    five = "(('0x' || substr(h, 1 + 10 * (i // 8)::int, 10))::bigint >> (35 - 5 * (i % 8)::int)) & 31"
    return f"""
with p as (select page_id, coalesce(html, '') as x, sha1(coalesce(html, '')) as h from pages),
q as (select *, min(page_id) over (partition by h) as f,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ({five}))::int, 1)),
                 'string_agg', '') as d from p)
select page_id, strlen(x)::bigint as payload_bytes, d as payload_digest,
       case when page_id = f then 'response' else 'revisit' end as record_type,
       case when page_id <> f then f end as refers_to,
       case when page_id = f then ceil((length_of_block) / {SEGMENT_BYTES}.0) else 1 end::int as segments,
       null::varchar as problem
from (select *, {len(_HTTP_HEAD) + len(b'Transfer-Encoding: chunked') + 4}
               + strlen(x) + 5
               + (strlen(x) // {HTTP_CHUNK}) * {len(b'%x' % HTTP_CHUNK) + 4}
               + case when strlen(x) % {HTTP_CHUNK} > 0 then length(to_hex(strlen(x) % {HTTP_CHUNK})) + 4 else 0 end
               as length_of_block from q)"""
