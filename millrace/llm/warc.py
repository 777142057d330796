"""WARC archives: writing with revisits and segments, and reading back with reassembly.

Each record is a gzip member of its own, as readers of compressed archives expect. Long blocks are written as a first segment and continuation records. The reader groups the
continuations by their origin's identifier, orders them by segment number, verifies the total
length, and decodes chunked transfer framing. Records without segments never leave their task.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import join_heavy, scratch

CRLF = b"\r\n"
RECORDS = (
    "record_id string, record_type string, refers_to string, uri string, page_id long, digest string, origin string, "
    "segment int, total long, block binary"
)


def _chunked(body: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(data: bytes) -> bytes:
    """The body inside chunked transfer framing; broken framing is an error."""
    parts, at = [], 0
    while True:
        end = data.index(CRLF, at)
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if len(data) < at + size + 2 or data[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk is cut off")
        parts.append(data[at : at + size])
        at += size + 2


def _record(kind: str, record_id: str, block: bytes, **headers) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + CRLF * 2 + block + CRLF * 2


def page_records(page_id, uri, body: bytes, digest: str, refers_to, segment_bytes: int, chunk_bytes: int):
    """The records of one page, in order. A page without an id has none in its records either."""
    record_id = f"urn:uuid:{uuid.uuid4()}"
    uri = "".join((uri or "urn:none").split())
    common = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{digest}", "X_Page_ID": page_id}
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(body)
        profile = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
        yield _record("revisit", record_id, head, **common, WARC_Profile=profile, X_Refers_To_Page_ID=refers_to)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + _chunked(body, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record("response", record_id, block, **common)
        return
    for n, at in enumerate(range(0, len(block), segment_bytes), 1):
        part = block[at : at + segment_bytes]
        if n == 1:
            yield _record("response", record_id, part, **common, WARC_Segment_Number=1)
        else:
            last = len(block) if at + segment_bytes >= len(block) else None
            yield _record(
                "continuation", f"urn:uuid:{uuid.uuid4()}", part, WARC_Target_URI=uri, WARC_Segment_Origin_ID=f"<{record_id}>",
                WARC_Segment_Number=n, WARC_Segment_Total_Length=last,
            )


def compress(record: bytes, level: int = 6) -> bytes:
    """A gzip member. Its last byte is the highest of the record's length: zero, for records below 16 MB."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def members(data: bytes, step: int = 8192):
    """The contents of the gzip members of an archive, one after the other; a cut member is an error."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, parts, end = zlib.decompressobj(31), [], at
        while not d.eof:
            if end >= len(view):
                raise ValueError("a gzip member is cut off")
            parts.append(d.decompress(view[end : end + step]))
            end += step
        at = min(end, len(view)) - len(d.unused_data)
        yield b"".join(parts)


def write_archives(
    pages: DataFrame, path: str, least_revisit: int = 1000, segment_bytes: int = 32_768, chunk_bytes: int = 8_192, file_bytes: int = 128 << 20
) -> str:
    """Write a record for each row of ``pages(page_id, url, html)`` to archives under ``path``.

    Of rows with equal payloads of at least ``least_revisit`` bytes those with the largest page id
    (all, if repeated) are responses and the others refer to it. Null pages count as empty, a null
    page id counts as the smallest and is never referred to. Other columns are not read, and an
    empty table gives no records. A record is at most a segment and its headers, and an archive holds
    as many records as segments fit into ``file_bytes``.
    """
    if not 0 < segment_bytes < 1 << 23:
        raise ValueError("segments must be smaller than 8 MB")
    full = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("body"),
    )
    keyed = full.withColumn("digest", F.sha1("body"))
    best = (
        keyed.where(F.length("body") >= least_revisit)
        .groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
        .where("n > 1 and best is not null").select("digest", "best", "n")
    )
    rows = join_heavy(keyed, best, ["digest"], "n", pages.count()).select(
        "page_id", "url", "body", "digest", F.when(F.col("page_id").isNull() | (F.col("best") != F.col("page_id")), F.col("best")).alias("refers_to")
    )

    def run(batches):
        for batch in batches:
            out = []
            for page_id, url, body, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                # The text sink adds the zero byte that ends a member.
                out += [compress(r)[:-1] for r in page_records(page_id, url, body, digest, refers_to, segment_bytes, chunk_bytes)]
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", max(1, file_bytes // segment_bytes)
    ).option("encoding", "UTF-8").option("lineSep", "\x00").text(path)
    return path


def parse(data: bytes):
    """Header fields and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(CRLF * 2, at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(fields["content-length"])
        yield fields, data[start:stop]
        at = stop + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of all archives under ``path``. A task holds an archive compressed, and unpacks record by record."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for f, block in (r for member in members(batch.column(0)[i].as_py()) for r in parse(member)):
                    number = lambda name: int(f[name]) if name in f else None  # noqa: B023, E731
                    record_id = f["warc-record-id"].strip("<>")
                    rows.append((
                        record_id, f["warc-type"], f.get("x-refers-to-page-id"), f.get("warc-target-uri"), number("x-page-id"),
                        f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        f.get("warc-segment-origin-id", record_id if "warc-segment-number" in f else "").strip("<>") or None,
                        number("warc-segment-number"), number("warc-segment-total-length"), block,
                    ))
                    if len(rows) >= 500:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    names = [x.split(" ")[0] for x in RECORDS.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: those without segments as they are, the others joined by origin.

    A missing segment, a doubled one or a wrong total length is an error. One group holds the
    segments of one record.
    """

    def join(key, t):
        rows = sorted(t.to_pylist(), key=lambda r: r["segment"])
        if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)):
            raise ValueError(f"segments of {key[0].as_py()} are missing or doubled")
        block = b"".join(r["block"] for r in rows)
        if rows[-1]["total"] != len(block):
            raise ValueError(f"segments of {key[0].as_py()} do not add up to their total length")
        return pa.Table.from_batches([_batch([(*[rows[0][k] for k in t.column_names[:8]], len(block), block)])])

    segmented = records.where("origin is not null").groupBy("origin").applyInArrow(join, RECORDS)
    return records.where("origin is null").unionAll(segmented)


def payloads(records: DataFrame) -> DataFrame:
    """``page_id, uri, record_type, refers_to, payload_bytes, payload_digest, payload`` of whole records.

    A revisit has no payload: its length and digest are those its headers state.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                head, _, body = r["block"].partition(CRLF * 2)
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
                if r["record_type"] == "revisit":
                    rows.append((r["page_id"], r["uri"], "revisit", int(r["refers_to"]), int(fields[b"content-length"]), r["digest"], None))
                    continue
                if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
                    body = dechunk(body)
                rows.append((r["page_id"], r["uri"], r["record_type"], None, len(body), hashlib.sha1(body).hexdigest(), body))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["page_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return records.where("record_type in ('response', 'revisit')").mapInArrow(
        run, "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read from them what each record holds."""
    path = write_archives(pages, scratch(spark, "warc"))
    return payloads(reassemble(read_records(spark, path)))
