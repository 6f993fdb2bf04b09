"""WARC archives: writing, normalising whole-file gzip streams, reading by offset.

Files go through ``pyarrow.fs``, so the folder may be any store that it knows by URI. Each
task writes to a name of its own; only names that a finished task has returned are read
later, so a lost or repeated task leaves at most an unread file.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, keep, small_batches, text_or_empty, work_dir

#: Payloads below this size are always stored in full.
LEAST_SHARED_BYTES = 100
#: zlib levels of the whole-file streams and of the records' own members.
STREAM_LEVEL, MEMBER_LEVEL = 1, 4
CHUNK = 1 << 20
#: Bytes of an archive after which the next record begins a new one, rows of an index that a
#: task holds at a time, and repeated digests that are broadcast (about 150 bytes each).
ARCHIVE_BYTES, INDEX_ROWS, BROADCAST_ROWS = 1 << 30, 10_000, 200_000
GZIP = 31  # zlib's window bits for gzip framing
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

INDEX = "path string, offset long, length long, record_type string, record_id string, target_uri string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, ``response_id`` and ``response_url``, null where the record is
    a response.

    Of the rows with one payload of ``LEAST_SHARED_BYTES`` or more, the smallest page_id is
    the response. Only digests that occur twice or more are joined back, so the groups are
    as few as the repeated payloads: they are broadcast up to ``BROADCAST_ROWS``, and no
    payload is shuffled; beyond, the join is an ordinary one that Spark can split where one
    payload is very common.
    """
    rows = pages.select("page_id", "url", text_or_empty("html").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    shared = (
        pages.select("page_id", "url", text_or_empty("html").alias("payload"))
        .filter(F.octet_length("payload") >= LEAST_SHARED_BYTES)
        .groupBy(F.sha2("payload", 256).alias("_digest"))
        .agg(F.min("page_id").alias("first_id"), F.min_by("url", F.struct("page_id", "url")).alias("first_url"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND first_id IS NOT NULL")
        .drop("n")
    )
    shared = broadcast_if_small(keep(shared, "shared_payloads"), BROADCAST_ROWS)
    joined = rows.join(shared, F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("response_id"), F.when(revisit, F.col("first_url")).alias("response_url"))


def _record_id(page_id: int | None, digest: str) -> str:
    """The id of a response, which its page and payload set, so that revisits can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _whole(text: str | None) -> int | None:
    return int(text) if text else None


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None, response_url: str | None) -> bytes:
    """The bytes of one record, not compressed. A revisit has the HTTP head but no payload. The
    page's own id, and that of the response of a revisit, stand in headers of our own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    first = response_id is None
    block = http + payload if first else http
    own = _record_id(page_id, digest) if first and page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if first else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if not first:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(response_id, digest)}", f"WARC-Refers-To-Target-URI: {_uri(response_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-Id: {response_id}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_streams(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives, each one gzip stream from its first to its last record, as many crawlers' tools
    leave them. A task begins a new one once the last has ``archive_bytes``, so that no file
    grows with the input. ``rows`` is as from :func:`with_record_types`. Returns the written
    table (path, records); a task without rows writes no file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, path = None, 0, ""

        def ended() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

        for batch in batches:
            for page_id, url, payload, digest, response_id, response_url in zip(*(batch.column(i) for i in range(6))):
                if out is None:
                    path, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    fs, local = _open(path)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out, packer = fs.open_output_stream(local, compression=None), zlib.compressobj(STREAM_LEVEL, zlib.DEFLATED, GZIP)
                body = payload.as_buffer().to_pybytes()
                out.write(packer.compress(record(page_id.as_py(), url.as_py(), body, digest.as_py(), response_id.as_py(), response_url.as_py())))
                n += 1
                if out.tell() >= archive_bytes:
                    yield ended()
                    out = None
        if out is not None:
            yield ended()

    return keep(small_batches(rows).mapInArrow(write, "path string, records long"), "streams")


def _inflated(stream) -> Iterator[bytes]:
    """The chunks of a gzip file, of one member or of several, in bounded memory; an empty file
    has none."""
    unpacker, left, begun = zlib.decompressobj(GZIP), b"", False
    while data := left or stream.read(CHUNK):
        begun = True
        if unpacker.eof:
            unpacker = zlib.decompressobj(GZIP)
        if piece := unpacker.decompress(data, CHUNK):
            yield piece
        left = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
    while begun and not unpacker.eof:
        if not (piece := unpacker.decompress(b"", CHUNK)):
            raise ValueError("the gzip stream breaks off")
        yield piece


class _Feed:
    """Bytes taken from chunks by number or up to a mark."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, bytearray()

    def more(self) -> bool:
        chunk = next(self.chunks, None)
        self.held += chunk or b""
        return chunk is not None

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end of the data."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held:
                    raise ValueError("the archive breaks off in a record's head")
                return None
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive breaks off in a record")
            piece = bytes(self.held[:n])
            del self.held[:n]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()}


def normalise(spark: SparkSession, streams: DataFrame, folder: str) -> DataFrame:
    """Rewrite whole-file gzip archives so that every record is a gzip member of its own.

    ``streams`` has the column ``path``. One task takes one file, as a gzip stream can only
    be read from its start: it inflates the file once, in chunks of 1 MB, and passes each
    record on through a fresh compressor, so no record and no file is ever whole in memory.
    Beside each new file lies ``<file>.idx``, one JSON line per record with offset, length,
    type, id and target; the same rows are returned as a written table (``INDEX``). Files
    already of several members are taken too. A file that breaks off is an error, never a
    shorter archive. No files give an empty index.
    """

    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                rows = _normalise_file(source, folder)
                while part := list(islice(rows, INDEX_ROWS)):
                    yield pa.RecordBatch.from_pylist(part, schema=schema)

    paths = streams.select("path")
    files = paths.count()
    return keep(paths.repartition(max(files, 1), F.xxhash64("path")).mapInArrow(rewrite, INDEX), "warc_index") if files else spark.createDataFrame([], INDEX)


def _normalise_file(source: str, folder: str) -> Iterator[dict]:
    """The rows of the new file's index, each once its record is written."""
    fs, local = _open(source)
    target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
    out_fs, out_local = _open(target)
    out_fs.create_dir(out_local.rpartition("/")[0], recursive=True)
    offset = 0
    with fs.open_input_stream(local, compression=None) as stream, out_fs.open_output_stream(out_local, compression=None) as out, out_fs.open_output_stream(out_local + ".idx", compression=None) as side:
        feed = _Feed(_inflated(stream))
        while (head := feed.until(b"\r\n\r\n")) is not None:
            if not head.startswith(b"WARC/"):
                raise ValueError(f"{source} is no WARC archive")
            fields, packer = _fields(head), zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, GZIP)
            out.write(packer.compress(head))
            for piece in feed.pieces(int(fields["content-length"]) + 4):
                out.write(packer.compress(piece))
            out.write(packer.flush())
            end = out.tell()
            row = {"path": target, "offset": offset, "length": end - offset, "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri")}
            side.write(json.dumps({k: v for k, v in row.items() if k != "path"}).encode() + b"\n")
            yield row
            offset = end


def read_records(index: DataFrame) -> DataFrame:
    """The records that ``index`` names, each read by its offset alone (``RECORDS``).

    A response's payload is hashed again and must agree with its head. A revisit's size is
    that of the HTTP head it keeps.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream = None, None
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            for p, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if p != path:
                    if stream is not None:
                        stream.close()
                    fs, local = _open(p)
                    path, stream = p, fs.open_input_file(local)
                stream.seek(offset)
                head, _, block = zlib.decompress(stream.read(length), GZIP).partition(b"\r\n\r\n")
                fields = _fields(head)
                http, _, payload = block[:-4].partition(b"\r\n\r\n")
                kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:"), len(payload)
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{p} at {offset}: the payload does not have its digest")
                if kind == "revisit":
                    size = int(_fields(http)["content-length"])
                for k, v in zip(rows, (_whole(fields.get("x-page-id")), size, digest, kind, _whole(fields.get("x-refers-to-page-id")))):
                    rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))
        if stream is not None:
            stream.close()

    return index.select("path", "offset", "length").mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Write ``pages`` (page_id, url, html) as whole-file streams and normalise them; returns
    (stream table, index).

    A null html is an empty payload, a null url an empty target. A row without page_id is a
    revisit where its payload has a response with an id, and a response otherwise. Rows that
    repeat the smallest page_id of a payload are each a response, with one record id, as they
    say the same; all other record ids are unique. An empty table gives no
    files and an empty index. Other columns are not looked at.
    """
    spark = pages.sparkSession
    folder = work_dir(spark, "warc")
    streams = write_streams(with_record_types(pages), f"{folder}/streams", archive_bytes)
    return streams, normalise(spark, streams, f"{folder}/members")


def op10(pages: DataFrame) -> DataFrame:
    return read_records(archive_pages(pages)[1])


SQL = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""
