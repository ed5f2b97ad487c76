"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames (so any one is read by decompressing a single frame); a bundle ends in the seek
table of the public seekable format, a skippable frame of every frame's sizes.  An index maps each record to bundle,
frame and offset inside the frame.

Plan: digests and sizes are computed in the JVM and grouped without the payloads; the decision (response or revisit) then
meets the payloads by page, so a payload that a third of all pages share does not gather them.  Bundles are
written by tasks to the shared folder, under a name of the attempt's own; the index is stored once, and only bundles that
it names count, so a lost executor leaves at most an unreferenced file.  Reading deals single frames to tasks, so neither a
large bundle nor many small ones gather in one.

Defined cases: a null html is an empty payload; a null url leaves the target header out; a null page_id is kept and never
the response of others; rows that repeat a page_id get a record each, and of equal payloads those with the
largest page_id are responses; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnloom.llm.common import shared_path, stored

#: Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class BundleOptions:
    frame_bytes: int = 1 << 18
    bundle_bytes: int = 1 << 26
    least_shared: int = 1000
    level: int = 3
    date: str = "2020-01-01T00:00:00Z"


# --- records ------------------------------------------------------------------------------------------------------


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record; a revisit (``refers_to`` given) has the HTTP head alone, whose length is the full payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _headers(data: bytes) -> dict[str, str]:
    return {k.decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in data.split(b"\r\n")[1:])}


def decode_records(data: bytes) -> Iterator[Record]:
    """The records of a decompressed frame."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        headers = _headers(data[at:stop])
        block = data[stop + 4 : stop + 4 + int(headers["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield Record(headers, _headers(http), payload)
        at = stop + 4 + len(block) + 4


# --- bundles ------------------------------------------------------------------------------------------------------


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(handle: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from the footer."""
    size = handle.size()
    handle.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", handle.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 128 else 8
    handle.seek(size - 9 - count * width)
    table, at, frames = handle.read(count * width), 0, []
    for k in range(count):
        packed, plain = struct.unpack_from("<II", table, k * width)
        frames.append((at, packed, plain))
        at += packed
    return frames


class _Bundle:
    """A bundle being written: frames of whole records, then the seek table."""

    def __init__(self, folder: str, options: BundleOptions):
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.path, self.options = f"{folder}/{name}", options
        self.out = system.open_output_stream(f"{path}/{name}", compression=None)
        self.pack = zstandard.ZstdCompressor(level=options.level)
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.waiting, self.rows, self.at = bytearray(), [], [], 0

    def add(self, page_id: int | None, record: bytes) -> None:
        self.waiting.append((page_id, len(self.frames), len(self.buffer), len(record)))
        self.buffer += record
        if len(self.buffer) >= self.options.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.buffer:
            packed = self.pack.compress(bytes(self.buffer))
            self.rows += [(page_id, self.path, frame, self.at, len(packed), offset, size) for page_id, frame, offset, size in self.waiting]
            self.frames.append((len(packed), len(self.buffer)))
            self.out.write(packed)
            self.at += len(packed)
            self.buffer, self.waiting = bytearray(), []

    def close(self) -> list[tuple]:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return self.rows


INDEX = "page_id long, bundle string, frame long, frame_at long, frame_size long, offset long, size long"
_INDEX = pa.schema([(n, pa.string() if n == "bundle" else pa.int64()) for n in ("page_id", "bundle", "frame", "frame_at", "frame_size", "offset", "size")])


def plan_records(pages: DataFrame, options: BundleOptions = BundleOptions()) -> DataFrame:
    """(page_id, url, html, digest, refers_to): what each page's record is."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    known = plain.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    large = known.filter(F.col("bytes") >= options.least_shared).select("page_id", "digest", "bytes")
    first = large.groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    later = large.join(first, "digest").filter("page_id < first").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")).distinct()
    met = known.join(later, (known["page_id"] == later["_page"]) & (known["digest"] == later["_digest"]), "left")
    return met.select("page_id", "url", "html", "digest", "refers_to")


def write(pages: DataFrame, options: BundleOptions = BundleOptions(), folder: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as bundles under ``folder``; returns the stored index."""
    folder = folder or shared_path(pages.sparkSession, "warc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle = bundle or _Bundle(folder, options)
                bundle.add(page_id, encode_record(page_id, url, html.encode("utf-8", "replace"), digest, refers_to, options.date))
                if bundle.at >= options.bundle_bytes:
                    yield _rows(bundle.close())
                    bundle = None
        if bundle:
            yield _rows(bundle.close())

    return stored(plan_records(pages, options).mapInArrow(work, INDEX), "warc-index")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)


def frames(index: DataFrame) -> DataFrame:
    """(bundle, at, packed, plain): the frames of the bundles that ``index`` names, by the bundles' own seek tables."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(name)
                with system.open_input_file(path) as handle:
                    found = read_seek_table(handle)
                columns = zip(*found, strict=True) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], names=["bundle", "at", "packed", "plain"])

    bundles = index.select("bundle").distinct()
    # By another expression than the bundle itself, or the partitioning of distinct() would do and be gathered into few tasks.
    bundles = bundles.repartition(_tasks(bundles.count(), bundles.sparkSession), F.xxhash64("bundle"))
    return bundles.mapInArrow(work, "bundle string, at long, packed long, plain long")


def _tasks(n: int, spark: SparkSession) -> int:
    """A task each to the session's parallelism, then several a task, then a hundred each."""
    return max(1, min(n, max(spark.sparkContext.defaultParallelism, n // 100)))


def read(spark: SparkSession, index: DataFrame, options: BundleOptions = BundleOptions()) -> DataFrame:
    """All records of the bundles that ``index`` names: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Frames are dealt to tasks one by one, about ``bundle_bytes`` of records a task, and fewer where there are cores for it.
    Payloads of responses are digested anew; a mismatch is an error.
    """

    def page(name: str | None) -> int | None:
        return int(name[10:-1]) if name and name.startswith("<urn:page:") else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            opened, handle = None, None
            for name, at, packed, plain in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != opened:
                    if handle:
                        handle.close()
                    system, path = fs.FileSystem.from_uri(name)
                    opened, handle = name, system.open_input_file(path)
                handle.seek(at)
                rows = []
                for r in decode_records(unpack.decompress(handle.read(packed), max_output_size=plain)):
                    digest = base64.b32decode(r.headers["WARC-Payload-Digest"][5:]).hex()
                    kind = r.headers["WARC-Type"]
                    if kind == "response" and hashlib.sha1(r.payload).hexdigest() != digest:
                        raise ValueError(f"payload of {r.headers['WARC-Record-ID']} is damaged")
                    rows.append((page(r.headers["WARC-Record-ID"]), int(r.http["Content-Length"]), digest, kind, page(r.headers.get("WARC-Refers-To"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], schema=_READ)
            if handle:
                handle.close()

    found = stored(frames(index), "warc-frames")
    n, size = found.agg(F.count("*"), F.coalesce(F.sum("plain"), F.lit(0))).first()
    tasks = max(-(-size // options.bundle_bytes), min(n, spark.sparkContext.defaultParallelism), 1)
    return found.repartition(tasks, F.xxhash64("bundle", "at")).sortWithinPartitions("bundle", "at").mapInArrow(work, READ)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_READ = pa.schema([(n, pa.string() if n in ("payload_digest", "record_type") else pa.int64()) for n in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")])


def read_record(entry: dict) -> Record:
    """One record by its index row: only its frame is read and decompressed."""
    system, path = fs.FileSystem.from_uri(entry["bundle"])
    with system.open_input_file(path) as handle:
        handle.seek(entry["frame_at"])
        data = zstandard.ZstdDecompressor().decompress(handle.read(entry["frame_size"]))
    return next(decode_records(data[entry["offset"] : entry["offset"] + entry["size"]]))
