"""Web archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends with a seek table
in a skippable frame (the public seekable format), so any frame can be read alone.  An index
maps record ids to (bundle, frame, offset in the frame).  Bundles go to the shared folder
through the file system its address names; each task attempt has its own file names, and only
the files named by finished tasks are ever read."""

from __future__ import annotations

import base64
import hashlib
import struct
from math import ceil

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import default_ranges, scratch_path
from .common import blank, written

INDEX = "page_id bigint, bundle string, frame bigint, offset bigint, record_type string"
RECORD = "page_id bigint, target_uri string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string, bundle string, frame bigint, offset bigint"

# Fixed values of the seekable format (little-endian 32-bit).
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_id(uri: str) -> int | None:
    number = uri.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def one_line(value: str) -> str:
    """Control characters and blanks percent-encoded: a header value stays on its line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def write_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response record, or a revisit without body that names the record it repeats."""
    kind = "revisit" if refers_to is not None else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_uri(page_id)), ("WARC-Date", date)]
    head += [("WARC-Target-URI", one_line(url))] if url is not None else []
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_uri(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """(headers, block, where the next record begins)."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    body, size = end + 4, int(head["Content-Length"])
    if data[body + size:body + size + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} is cut short")
    return head, data[body:body + size], body + size + 4


def _file_system(uri: str):
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class BundleWriter:
    """Frames of about ``frame_bytes`` (a longer record has a frame to itself), then the table."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        import zstandard

        system, path = _file_system(uri)
        self.uri, self.stream, self.frame_bytes = uri, system.open_output_stream(path, compression=None), frame_bytes
        self.compress, self.frames, self.buffer = zstandard.ZstdCompressor(level=level, write_checksum=True).compress, [], bytearray()
        self.size = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset) of the record."""
        if self.buffer and len(self.buffer) + len(record) > self.frame_bytes:
            self._end_frame()
        place = len(self.frames), len(self.buffer)
        self.buffer += record
        return place

    def _end_frame(self):
        packed = self.compress(bytes(self.buffer))
        self.stream.write(packed)
        self.frames.append((len(packed), len(self.buffer)))
        self.size += len(packed)
        self.buffer.clear()

    def close(self):
        if self.buffer:
            self._end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


def seek_table(uri: str) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the end of the bundle."""
    system, path = _file_system(uri)
    with system.open_input_file(path) as f:
        total = f.size()
        f.seek(total - 9)
        count, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        f.seek(total - 9 - 8 * count)
        sizes = list(struct.iter_unpack("<II", f.read(8 * count)))
    starts = [0]
    for packed, _ in sizes:
        starts.append(starts[-1] + packed)
    return [(s, *z) for s, z in zip(starts, sizes)]


def read_frame(uri: str, start: int, packed: int) -> bytes:
    import zstandard

    system, path = _file_system(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return zstandard.ZstdDecompressor().decompress(f.read(packed))


def _write_bundles(folder: str, frame_bytes: int, bundle_bytes: int, level: int, date: str):
    def run(batches):
        context, writer, number = TaskContext.get(), None, 0
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                    if writer is None:
                        writer = BundleWriter(f"{folder}/bundle-{context.partitionId():06d}-{number:04d}-{context.taskAttemptId()}.warc.zst", frame_bytes, level)
                    payload = html.encode()
                    frame, offset = writer.add(write_record(page_id, url, payload, payload_digest(payload), refers_to, date))
                    rows.append((page_id, writer.uri, frame, offset, "response" if refers_to is None else "revisit"))
                    if writer.size >= bundle_bytes:
                        writer.close()
                        writer, number = None, number + 1
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "bundle", "frame", "offset", "record_type"])
        if writer is not None:
            writer.close()
    return run


def repeats(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, refers_to): pages whose payload, of at least ``least_bytes``, equals that of a
    page with a smaller id, and the smallest such id.  Null ids refer but are not referred to."""
    html = blank("html")
    ids = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha2(html.cast("binary"), 256).alias("sha"), F.octet_length(html).alias("size"))
    ids = ids.where(F.col("size") >= least_bytes).select("page_id", "sha")
    first = ids.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return ids.join(first, "sha").where("refers_to is not null and not (page_id <=> refers_to)").select("page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, frame_bytes: int = 1 << 18,
                   bundle_bytes: int = 1 << 26, level: int = 3, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row of (page_id, url, html) and return the index: page_id,
    bundle, frame, offset, record_type.  A null html is empty, a null url has no target line;
    rows that repeat an id and its payload are written each, with the same type."""
    system, path = _file_system(folder)
    if isinstance(system, fs.LocalFileSystem):
        system.create_dir(path, recursive=True)
    html = blank("html")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("sha"))
    again = repeats(pages, least_bytes).select(F.col("page_id").alias("again_id"), F.col("sha").alias("again_sha"), "refers_to")
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["again_id"]) & (rows["sha"] == again["again_sha"]), "left")
    run = _write_bundles(folder, frame_bytes, bundle_bytes, level, date)
    return written(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, INDEX), "warc-index")


def _frames(batches):
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            table = seek_table(uri)
            yield pa.RecordBatch.from_arrays([pa.array([uri] * len(table), pa.string()), pa.array(range(len(table)), pa.int64()),
                                              *(pa.array([f[k] for f in table], pa.int64()) for k in (0, 1))], names=["bundle", "frame", "start", "packed"])


def parse_record(head: dict, block: bytes) -> tuple:
    """page_id, target, payload size and digest of the full payload, type, refers_to, payload
    (null for a revisit); a response whose payload does not give its digest raises."""
    cut = block.index(b"\r\n\r\n")
    size = int(next(x for x in block[:cut].decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest, payload = head["WARC-Payload-Digest"].removeprefix("sha1:"), None
    if head["WARC-Type"] == "response":
        payload = block[cut + 4:]
        if payload_digest(payload) != digest or len(payload) != size:
            raise ValueError(f"record {head['WARC-Record-ID']} has another payload than its digest says")
    refers = head.get("WARC-Refers-To")
    return (record_id(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"],
            None if refers is None else record_id(refers), None if payload is None else payload.decode())


def _records(with_payload: bool):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for uri, frame, start, packed in zip(*(c.to_pylist() for c in batch.columns)):
                data, at, rows = read_frame(uri, start, packed), 0, []
                while at < len(data):
                    head, block, after = read_record(data, at)
                    row = parse_record(head, block)
                    rows.append((*row[:6], row[6] if with_payload else None, uri, frame, at))
                    at = after
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    return run


def read_archives(spark: SparkSession, bundles: DataFrame, with_payload: bool = True, task_bytes: int = 1 << 25) -> DataFrame:
    """Every record of the bundles named by the first column: the seek tables are read first,
    then the frames are dealt to tasks and read each on its own."""
    names = bundles.select(F.col(bundles.columns[0]).alias("bundle")).distinct()
    frames = written(names.mapInArrow(_frames, "bundle string, frame bigint, start bigint, packed bigint"), "warc-frames")
    size = frames.agg(F.sum("packed")).first()[0] or 0
    tasks = max(default_ranges(spark), ceil(size / task_bytes))  # by bytes: the frame rows themselves are tiny
    return frames.repartition(tasks, "bundle", "frame").mapInArrow(_records(with_payload), RECORD)


def fetch_records(spark: SparkSession, index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the given page ids: only the frames that hold them are read."""
    wanted = index.join(ids.select("page_id").distinct(), "page_id")
    frames = wanted.select("bundle").distinct().mapInArrow(_frames, "bundle string, frame bigint, start bigint, packed bigint")
    frames = frames.join(wanted.select("bundle", "frame").distinct(), ["bundle", "frame"])
    found = frames.select("bundle", "frame", "start", "packed").mapInArrow(_records(True), RECORD)
    return found.join(wanted.select("bundle", "frame", "offset"), ["bundle", "frame", "offset"], "left_semi")


def archive_round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write archives of the pages and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to.  No rows give no rows; other columns are not read."""
    index = write_archives(pages, scratch_path(spark, "warc"), least_bytes)
    return read_archives(spark, index.select("bundle"), with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
