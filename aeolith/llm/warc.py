"""WARC archives: records written in segments, read back and reassembled.

A payload is framed in HTTP chunks.  A block longer than a segment goes on in
continuation records, which name the first record by its id and carry a segment
number, the last also the total length.  Reading groups segments by that id,
orders them, verifies numbers and length, and then decodes the chunks.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import hottest, lookup, parted
from .storage import new_path, stored

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
ARCHIVE_BYTES = 32 << 20
_READ_BYTES = 1 << 20
_CRLF = b"\r\n"


class WarcError(ValueError):
    """A record or a chunked body is malformed."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, _CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def decode_chunked(body: bytes) -> bytes:
    """The payload; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.find(_CRLF, at)
        if end < 0:
            raise WarcError("chunk size is missing")
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError as error:
            raise WarcError("chunk size is no number") from error
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[at + size : at + size + 2] != _CRLF:
            raise WarcError("chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def decode_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower case) and the decoded payload of an HTTP response."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("HTTP header does not end")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return headers, decode_chunked(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def response_records(page_id: object, url: str | None, payload: bytes, date: str, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The response record of a payload and its continuations."""
    origin = f"<urn:uuid:{uuid.uuid4()}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + encode_chunked(payload)
    many = len(block) > segment
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    out = []
    for number, at in enumerate(range(0, len(block), segment), 1):
        last = at + segment >= len(block)
        fields: list[tuple[str, object]] = [("WARC-Date", date), ("WARC-Page-ID", page_id), ("WARC-Target-URI", clean)]
        if number == 1:
            fields += [("WARC-Type", "response"), ("WARC-Record-ID", origin), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http;msgtype=response")]
        else:
            fields += [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Segment-Origin-ID", origin)]
        if many:
            fields += [("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", len(block) if last else None)]
        out.append(record(fields, block[at : at + segment]))
    return out


def revisit_record(page_id: object, url: str | None, payload: bytes, refers_to: object, date: str) -> bytes:
    """A revisit of the page ``refers_to``: the HTTP header alone, with the length of the payload."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Page-ID", page_id), ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To-Page-ID", refers_to), ("Content-Type", "application/http;msgtype=response"),
    ]
    return record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))


def _writer(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out, path, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                records = [revisit_record(page_id, url, payload, refers_to, date)] if refers_to is not None else response_records(page_id, url, payload, date)
                for raw in records:
                    if out is None:
                        path = f"{root}/{uuid.uuid4().hex}.warc.gz"  # a task run again writes other files
                        out, size, n = fs.open_output_stream(path, compression=None), 0, 0
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    packed = packer.compress(raw) + packer.flush()
                    out.write(packed)
                    size, n = size + len(packed), n + 1
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        done.append((path, n))
                        out = None
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.record_batch([pa.array([p.rsplit("/", 1)[1] for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["file", "records"])

    return write


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Writes one record a row into the shared folder; returns the folder and the (stored) list of its archives.

    A null payload is empty.  Of equal payloads of at least ``min_revisit_bytes``
    the one with the smallest id is a response and the others revisit it; repeated
    rows of that id are responses all, and so are rows of a group without any id.
    Only files in the list count: a lost task's files are left unread.  Only payloads
    that may have an equal one are shuffled, those of frequent ones dealt.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "archives")
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("body")).withColumn("digest", F.sha1("body"))
    groups = rows.where(F.length("body") >= min_revisit_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = stored(groups, "equal-payloads")
    maybe, lone = parted(groups, "digest", rows, F.col("digest"))
    looked = lookup(maybe, "digest", groups.drop("n"), "left", hottest(groups, "digest"))
    rows = looked.select("id", "url", "body", "first").unionByName(lone.select("id", "url", "body", F.lit(None).cast("long").alias("first")))
    refers_to = F.when((F.length("body") >= min_revisit_bytes) & ~F.col("first").eqNullSafe(F.col("id")), F.col("first"))
    listed = rows.select("id", "url", "body", refers_to.alias("refers_to")).mapInArrow(_writer(folder, date), "file string, records long")
    return folder, stored(listed, "archive-list")


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record of a stream of gzip members, holding one record at a time."""
    unpack, data, ended = zlib.decompressobj(31), bytearray(), False
    spare = b""

    def more() -> bool:
        nonlocal unpack, spare, ended
        raw = spare or stream.read(_READ_BYTES)
        spare = b""
        if not raw:
            ended = True
            return False
        if unpack.eof:
            unpack = zlib.decompressobj(31)
        data.extend(unpack.decompress(raw))
        spare = unpack.unused_data
        return True

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not more():
                if data.strip():
                    raise WarcError("archive is cut short")
                return
        head = bytes(data[:end]).decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise WarcError("no WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        if not fields.get("content-length", "").isdecimal():
            raise WarcError("record without a length")
        length = int(fields["content-length"])
        while len(data) < end + 8 + length:
            if not more():
                raise WarcError("record is cut short")
        yield fields, bytes(data[end + 4 : end + 4 + length])
        del data[: end + 8 + length]


_RECORD = "origin string, number int, total long, type string, page_id string, refers_to string, digest string, block binary"
_BATCH_BYTES = 8 << 20


def _rows_of(stream, name: str) -> Iterator[tuple]:
    """A row a record; one whose fields are wrong has an error instead of a place among segments, and so has an archive's unreadable rest."""
    try:
        for f, block in parse_records(stream):
            page, segment = f.get("warc-page-id"), [f.get("warc-segment-number"), f.get("warc-segment-total-length")]
            known = (f.get("warc-type"), None if page == "None" else page, f.get("warc-refers-to-page-id"), f.get("warc-payload-digest"))
            origin = f.get("warc-segment-origin-id", f.get("warc-record-id"))
            if origin is None or known[0] is None or not all(x is None or (x.isdecimal() and int(x) < most) for x, most in zip(segment, (1 << 31, 1 << 63), strict=True)):
                yield (origin, None, None, *known, None, "fields are missing or no numbers")
            else:
                yield (origin, *[x and int(x) for x in segment], *known, block, None)
    except (WarcError, zlib.error) as error:
        yield (None,) * 8 + (f"{name}: {error}",)


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        names = ["origin", "number", "total", "type", "page_id", "refers_to", "digest", "block", "error"]
        kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for row in _rows_of(stream, name):
                        rows.append(row)
                        size += len(row[7] or b"") + 500
                        if size >= _BATCH_BYTES:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return read


def read_records(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """The records of the listed archives, not yet reassembled.

    A record with wrong fields is a row with an ``error``.  Where an archive is cut short
    or its records cannot be told apart, one such row stands for all that follows in it.
    """
    files = listed.select("file").repartition(spark.sparkContext.defaultParallelism * 4, "file")
    return files.mapInArrow(_reader(folder), f"{_RECORD}, error string")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for kind, page, refers, digest, blocks, wrong in zip(*[batch.column(c).to_pylist() for c in ("type", "page_id", "refers_to", "digest", "blocks", "error")], strict=True):
            declared = (digest or "").removeprefix("sha1:")
            try:
                if wrong or blocks is None:
                    raise WarcError(wrong or "segments are missing")
                headers, payload = decode_http(b"".join(blocks))
                if kind == "revisit":
                    out.append((page, int(headers["content-length"]), declared, kind, refers, None, None))
                elif base32_sha1(payload) != declared:
                    raise WarcError("payload differs from its digest")
                else:
                    out.append((page, len(payload), declared, kind, refers, payload, None))
            except (WarcError, KeyError, ValueError) as error:
                out.append((page, None, declared, kind, refers, None, str(error)))
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "error"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def reassembled(records: DataFrame) -> DataFrame:
    """Page id, payload and kind of each whole record; ``error`` tells why one has no payload.

    Segments of one origin are gathered in one row, so memory is bounded by one
    payload.  A group with a number missing or doubled, or another length than its
    last segment states, has an error and no payload.
    """
    columns = ["type", "page_id", "refers_to", "digest"]
    if "error" not in records.columns:
        records = records.withColumn("error", F.lit(None).cast("string"))
    single = records.where("number IS NULL").select(*columns, F.when(F.col("block").isNotNull(), F.array("block")).alias("blocks"), "error")
    parts = records.where("number IS NOT NULL").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "block", "type", "page_id", "refers_to", "digest"))).alias("s"), F.max("total").alias("total"))
    ordered = F.expr("transform(s, x -> x.number) = sequence(1, size(s)) AND total = aggregate(s, 0L, (a, x) -> a + octet_length(x.block))")
    first = F.col("s")[0]
    whole = parts.select(*[first[c].alias(c) for c in columns], F.when(ordered, F.col("s.block")).alias("blocks"), F.lit(None).cast("string").alias("error"))
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary, error string"
    return single.unionByName(whole).mapInArrow(_decode, schema)
