"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each a group of whole records, then a skippable frame with the
record index (JSON lines: record id, frame, offset in the frame's plain bytes, length), then a skippable frame with
the seek table of the Zstandard seekable format: compressed and plain size of each frame, their number, and the
magic number at the very end. One record is read by the footer, the index and a single frame.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import _common as C

SKIPPABLE = 0x184D2A5E
INDEX = 0x184D2A5D
SEEKABLE = 0x8F92EAB1
#: Plain bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
#: Records after which a bundle is closed in any case, as its index is held in memory.
BUNDLE_RECORDS = 500_000
#: Payloads below this size are never replaced by a revisit record.
LEAST_REVISIT = 100
LEVEL = 3


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Date of records whose writer is told none.
EPOCH = "1970-01-01T00:00:00Z"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, record_id: str | None = None, date: str = EPOCH) -> bytes:
    """One WARC/1.1 record. A response's block is an HTTP response with the payload; a revisit has no block, its headers
    hold the size and digest of the full payload and the page whose payload is the same."""
    block = HTTP % len(payload) + payload if kind == "response" else b""
    page = "null" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id or f'urn:page:{page}'}>", f"WARC-Date: {date}", f"X-Page-ID: {page}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, place of the next record) of the record at `at`."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    body = raw.index(b"\r\n\r\n", start) + 4 if stop > start else start
    return headers, raw[body:stop], stop + 4


class Bundle:
    """Writes one bundle."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.waiting: list[bytes] = []
        self.held = self.size = self.records = 0
        self.frames: list[tuple[int, int]] = []
        self.index: list[bytes] = []

    def add(self, key: str, raw: bytes) -> None:
        """Add a record under its identifier, which must be new to the bundle."""
        self.index.append(json.dumps([key, len(self.frames), self.held, len(raw)]).encode())
        self.waiting.append(raw)
        self.held += len(raw)
        self.records += 1
        if self.held >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.waiting:
            packed = self.zstd.compress(b"".join(self.waiting))
            self.stream.write(packed)
            self.frames.append((len(packed), self.held))
            self.size += len(packed)
            self.waiting, self.held = [], 0

    def close(self) -> None:
        self._flush()
        index = self.zstd.compress(b"\n".join(self.index))
        self.stream.write(struct.pack("<II", INDEX, len(index)) + index)
        frames = [*self.frames]
        table = b"".join(struct.pack("<II", *x) for x in [*frames, (len(index) + 8, 0)])
        footer = struct.pack("<IBI", len(frames) + 1, 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.stream.close()


class BundleFile:
    """Reads a bundle by its seek table."""

    def __init__(self, file: pa.NativeFile):
        self.file, size = file, file.size()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or flags & 0x80:
            raise ValueError("not a seekable bundle without checksums in its table")
        file.seek(size - 9 - 8 * n)
        sizes = np.frombuffer(file.read(8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes[:, 0])]).tolist()
        self.sizes = sizes.tolist()
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        self.file.seek(self.starts[i])
        return self.zstd.decompress(self.file.read(self.sizes[i][0]), max_output_size=self.sizes[i][1])

    def frames(self) -> Iterator[bytes]:
        for i in range(len(self.sizes) - 1):
            yield self.frame(i)

    def index(self) -> dict[str, tuple[int, int, int]]:
        """Record id to (frame, offset in the frame, length)."""
        self.file.seek(self.starts[-2] + 8)
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(self.file.read(self.sizes[-1][0] - 8))
        return {k: (f, o, n) for k, f, o, n in map(json.loads, raw.split(b"\n")) if raw} if raw else {}

    def read(self, key: str) -> tuple[dict[str, str], bytes]:
        """(headers, payload) of one record, decompressing its frame alone."""
        frame, offset, _ = self.index()[key]
        return parse(self.frame(frame), offset)[:2]

    def records(self) -> Iterator[list[tuple[str, dict[str, str], bytes]]]:
        """(record id, headers, payload) of all records by way of the index, a list for each frame; every frame is
        decompressed once."""
        by_frame: dict[int, list[tuple[int, int, str]]] = {}
        for key, (frame, offset, size) in self.index().items():
            by_frame.setdefault(frame, []).append((offset, size, key))
        for frame, held in sorted(by_frame.items()):
            raw, out, at = self.frame(frame), [], 0
            for offset, size, key in sorted(held):
                headers, payload, end = parse(raw, offset)
                if offset != at or end != offset + size:
                    raise ValueError(f"the index has {key} in another place")
                out.append((key, headers, payload))
                at = end
            if at != len(raw):
                raise ValueError(f"frame {frame} holds records that the index lacks")
            yield out


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT, date: str | None = None) -> DataFrame:
    """Write a record for each row and return the manifest: path, records. `date` is the records' date in UTC, the
    time of the call if None.

    The payload is the text in UTF-8 (null: empty). Of rows with equal payloads of at least `least` bytes, those with
    the smallest id are responses and the others revisit that id; a null id is never the smallest, and where all ids
    are null all are responses. Repeated rows are records of their own: a record's identifier comes from its bundle's
    name and its place there. Payloads stay where they were read: the digests that recur, one row each, are written
    first, so that the engine knows their size and broadcasts them if they are few; else it deals both sides by digest,
    where skew handling can split a hot payload's rows.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    C.small_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = C.cut(groups.where("n > 1 and first is not null").select("digest", "first"), "recurring")
    rows = rows.join(groups, "digest", "left").select("page_id", "url", "digest", "payload", "first")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, done = None, []
        for batch in C.batches(parts):
            for page_id, url, digest, body, first in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if bundle is None:
                    path, stream = C.write_shared(folder, "pages")
                    bundle = Bundle(stream)
                revisit = first is not None and page_id != first
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{path}#{bundle.records}").urn
                bundle.add(name, record("revisit" if revisit else "response", page_id, url, body, len(body), digest, first, name, date))
                if bundle.size >= BUNDLE_BYTES or bundle.records >= BUNDLE_RECORDS:
                    bundle.close()
                    done.append((path, bundle.records))
                    bundle = None
        if bundle is not None:
            bundle.close()
            done.append((path, bundle.records))
        if done:
            yield pa.RecordBatch.from_pydict({"path": [x for x, _ in done], "records": [n for _, n in done]})

    return C.cut(rows.mapInArrow(write, "path string, records long"), "warc-manifest")


def read_bundles(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """All records of the bundles, found through their indexes: page_id, url, record_type, payload (null for revisits),
    payload_bytes, payload_digest (checked against the payload of responses) and refers_to. The driver gathers one row a
    bundle."""
    paths = [(r.path,) for r in manifest.select("path").orderBy("path").collect()]
    files = spark.createDataFrame(paths, "path string").repartition(max(1, len(paths)))
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def number(x: str | None) -> int | None:
        return None if x in (None, "null", "None") else int(x)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for path in batch.column("path").to_pylist():
                with C.read_shared(path) as file:
                    for frame in BundleFile(file).records():
                        out = []
                        for key, head, payload in frame:
                            kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                            if head["WARC-Record-ID"] != f"<{key}>" or kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["X-Payload-Length"])):
                                raise ValueError(f"{path}: damaged record {key}")
                            out.append((number(head["X-Page-ID"]), head.get("WARC-Target-URI"), kind, payload if kind == "response" else None, int(head["X-Payload-Length"]), digest, number(head.get("X-Refers-To-Page"))))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    return files.mapInArrow(read, schema)


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages as bundles in the shared folder and return the records read back from them."""
    spark = pages.sparkSession
    return read_bundles(spark, write_bundles(pages, C.shared_folder(spark, "warc")))
