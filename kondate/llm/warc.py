"""WARC archives: writing records with segmentation and chunked framing, and reassembling them."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kondate.llm.common import Scratch, broadcast_if_small, join_by_key

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "page_id long, origin string, record_type string, segment int, total long, payload_digest string, refers_to long, body binary, problem string"
#: Bytes of blocks that a task hands on at a time.
_OUT_BYTES = 1 << 24
_SIZE = re.compile(rb"[0-9A-Fa-f]+\Z")
_KINDS = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
_NAMES = [x.split()[0] for x in PARSED.split(", ")]


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing, ended by the empty chunk."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError on a broken frame. Chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        digits = framed[at:end].split(b";")[0].strip()
        if not _SIZE.match(digits):
            raise ValueError("a chunk's size is no number")
        size = int(digits, 16)
        if not size:
            return b"".join(parts)
        at = end + 2
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk ends early")
        parts.append(framed[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The HTTP payload in a response record's block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def records_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, record_id: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit without its payload, or a response, cut into segments if longer than one."""
    target = "".join(c if 33 <= ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "") or None
    common = [("WARC-Record-ID", record_id), ("WARC-Target-URI", target), ("Page-Id", page_id), ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}")]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("Refers-To-Page-Id", refers_to)], HTTP)
        return
    block = HTTP + chunked(payload, chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{record_id[:-1]}/{n}>"), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part)


def inflated(data: bytes) -> tuple[bytes, str | None]:
    """An archive without its compression, whole or by record, and what is wrong with that, if anything."""
    plain = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            plain.append(member.decompress(data) + member.flush())
        except zlib.error as e:
            return b"".join(plain), f"compression: {e}"
        if not member.eof:
            return b"".join(plain), "compression: the file is cut short"
        data = member.unused_data
    return b"".join(plain) or data, None


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Fields (names in lower case), block and problem of each record of an archive. What can't be read is one with a problem."""
    data, problem = inflated(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            yield {}, b"", "the header doesn't end"
            break
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = end + 4
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            yield fields, b"", "the content length is missing or no number"
            continue
        block = data[at : at + int(length)]
        yield fields, block, None if len(block) == int(length) else "the block is cut short"
        at += int(length)
    if problem:
        yield {}, b"", problem


def revisits(pages: DataFrame, least_bytes: int, scratch: Scratch) -> DataFrame:
    """page_id, digest, refers_to of the pages that repeat the payload of a smaller page_id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), _payload().alias("_p")).select("page_id", F.octet_length("_p").alias("bytes"), F.unhex(F.sha2("_p", 256)).alias("digest"))
    rows = scratch.table(rows.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest"), "digests")
    first = scratch.table(rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "first")
    return join_by_key(rows, first, ["digest"], "n").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def _payload():
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100, segment_bytes: int = 1 << 10, chunk_bytes: int = 1 << 10, file_records: int = 1 << 16) -> None:
    """One record per page (more if segmented) as gzipped WARC files in a folder of any file system that Spark writes.

    Of pages with equal payloads of at least `least_bytes` the smallest page_id is the response, the others revisit
    it. Pages stay in their partitions: the list of revisits is joined by broadcast while it is short (counted), by
    shuffle beyond that. A file holds at most `file_records` records of at most `segment_bytes` and a header. A null
    html is an empty payload; a null page_id or url leaves its field out, and a page without identifier is a response.
    """
    scratch = Scratch(pages.sparkSession, "warc-revisits")
    again = scratch.table(revisits(pages, least_bytes, scratch), "revisits")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("html"))
    keyed = rows.withColumn("digest", F.unhex(F.sha2("html", 256))).join(broadcast_if_small(again, again.count(), 96), ["page_id", "digest"], "left")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            out, size = [], 0
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "at")]
            for page_id, url, html, refers_to, at in zip(*columns, strict=True):
                done += 1
                for record in records_of(page_id, url, html, refers_to, f"<urn:page:{page_id}:{at}:{done}>", segment_bytes, chunk_bytes):
                    out.append(record)
                    size += len(record)
                if size > _OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = keyed.withColumn("at", F.spark_partition_id()).mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).mode("overwrite").text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record_type, payload_digest, refers_to, payload, problem of every response and revisit in a folder.

    Each file is read and parsed once. Records are shuffled by the identifier of their origin (their own, unless they
    continue another) and sorted by segment number; then each origin's segments are joined as they stream by, checked
    for gaps and against the total length, and decoded. A record that fails a check has a null payload and says so in
    `problem`, and so does what can't be read as a record; a revisit has no payload of its own.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                out, size = [], 0
                for n, (fields, block, problem) in enumerate(parse_records(content.as_py())):
                    number = lambda k, f=fields: int(f[k]) if f.get(k, "").isdigit() else None
                    origin = fields.get("warc-segment-origin-id", fields.get("warc-record-id")) or f"{path}#{n}"
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    out.append((number("page-id"), origin, fields.get("warc-type"), number("warc-segment-number"), number("warc-segment-total-length"), digest, number("refers-to-page-id"), block, problem))
                    size += len(block)
                    if size > _OUT_BYTES:
                        yield _batch(out)
                        out, size = [], 0
                yield _batch(out)

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out, size = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
                if held and row[1] != held[0][1]:
                    out.append(joined(held))
                    size += len(out[-1][7] or b"")
                    held = []
                    if size > _OUT_BYTES:
                        yield _batch(out)
                        out, size = [], 0
                held.append(row)
            yield _batch(out)
        yield _batch([joined(held)] if held else [])

    wanted = files.mapInArrow(parse, PARSED).where("record_type in ('response', 'revisit', 'continuation') or problem is not null")
    records = wanted.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(reassemble, PARSED)
    return records.select("page_id", "record_type", "payload_digest", "refers_to", F.col("body").alias("payload"), "problem")


def joined(segments: list[tuple]) -> tuple:
    """One row of an origin's rows, sorted by segment number; repeats of a number are dropped."""
    rows = [r for i, r in enumerate(segments) if not i or r[3] is None or r[3] != segments[i - 1][3]]
    page_id, origin, kind, number, _, digest, refers_to, block, problem = rows[0]
    payload, total = None, [r[4] for r in rows if r[4] is not None]
    problem = next((r[8] for r in rows if r[8]), None)
    if not problem and kind != "revisit":
        if number is not None or len(rows) > 1:
            block = b"".join(r[7] for r in rows)
            if [r[3] for r in rows] != list(range(1, len(rows) + 1)):
                problem = "segments are missing"
            elif total != [len(block)]:
                problem = "the total length differs"
        if not problem:
            try:
                payload = payload_of(block)
            except ValueError as e:
                problem = f"framing: {e}"
    return page_id, origin, "response" if kind == "continuation" else kind, len(rows), None, digest, refers_to, payload, problem


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 100) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem: pages written and read back.

    Length and digest are of the full payload; a revisit's length comes from the response it refers to. Segments are
    short, so that most pages are written in several and put together again. Repeated rows have a record each. An empty table gives an empty result. Columns beside page_id, url and html are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = folder or scratch.path("archives")
    write_archives(pages, folder, least_bytes)
    read = read_archives(spark, folder)
    found = F.sha2(F.col("payload"), 256)
    checked = F.coalesce("problem", F.when(found != F.col("payload_digest"), "the digest differs"))
    narrow = read.select("page_id", "record_type", F.coalesce(found, "payload_digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "refers_to", checked.alias("problem"))
    narrow = scratch.table(narrow, "read")
    back = narrow.where("record_type = 'revisit'").select("page_id", "payload_digest", "refers_to")
    back = scratch.table(back, "revisits")
    wanted = back.groupBy("refers_to", "payload_digest").agg(F.count("*").alias("n"))
    original = narrow.where("record_type = 'response' and payload_bytes is not null").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("_bytes")).distinct()
    original = scratch.table(original.join(wanted, ["refers_to", "payload_digest"]), "originals")
    back = join_by_key(back, original, ["refers_to", "payload_digest"], "n", "left").withColumn("record_type", F.lit("revisit"))
    back = back.select("page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.when(F.col("_bytes").isNull(), "its response is missing").alias("problem"))
    return narrow.where("record_type is null or record_type <> 'revisit'").select(back.columns).unionByName(back)
