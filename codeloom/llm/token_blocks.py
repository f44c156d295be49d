"""Token-ID output: patched frame-of-reference blocks.

File format, little-endian throughout:

    b"PFR1"
    blocks of BLOCK ids: u32 minimum, u8 width, u16 number of exceptions, BLOCK * width bits (ids minus the
        minimum, low bits first; exceptions as 0), u16 positions and u32 values of the exceptions
    index: u64 start of each block
    documents: u8 whether the id is null, i64 id, u64 number of ids
    footer: u64 place of the index, u64 blocks, u64 documents, u64 ids, b"PFR1"

The width of a block is the PERCENTILE of its values' widths; what is wider is an exception. The last block is
filled up with its last value; the footer's count of ids says how many are real.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import _common as C
from codeloom.llm._tokens import encoder

MAGIC = b"PFR1"
BLOCK = 512
PERCENTILE = 90
#: Ids after which a file is closed and the next begun: about a quarter of a GB.
FILE_IDS = 1 << 27
_FOOTER = struct.Struct("<QQQQ4s")
_HEAD = struct.Struct("<IBH")
_DOC = np.dtype([("null", "u1"), ("id", "<i8"), ("n", "<u8")])


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """Whole blocks as bytes. len(ids) is a multiple of BLOCK."""
    values = ids.reshape(-1, BLOCK).astype("<u4")
    low = values.min(axis=1)
    values -= low[:, None]
    # The percentile of the values' widths is the width of their percentile.
    k = min(BLOCK - 1, BLOCK * percentile // 100)
    width = np.frexp(np.partition(values, k, axis=1)[:, k].astype(np.float64))[1]
    out: list[bytes] = [b""] * len(values)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        block = values[at]
        over = block > np.uint32((1 << w) - 1)
        packed = _pack(np.where(over, 0, block).astype("<u4"), w)
        several = over.any(axis=1)
        for i, b in enumerate(at.tolist()):
            where = np.flatnonzero(over[i]) if several[i] else _NONE
            out[b] = b"".join((_HEAD.pack(int(low[b]), w, len(where)), packed[i].tobytes(), where.astype("<u2").tobytes(), block[i, where].tobytes()))
    return out


_NONE = np.zeros(0, np.int64)


def _lane(w: int) -> int:
    """Bytes of the smallest integer that holds w bits."""
    return 1 if w <= 8 else 2 if w <= 16 else 4


def _pack(block: np.ndarray, w: int) -> np.ndarray:
    """The low w bits of each value of each block, low bits first."""
    n, lane = len(block), _lane(w)
    raw = block.astype(f"<u{lane}").view(np.uint8)
    if w == 8 * lane:
        return raw.reshape(n, -1)
    bits = np.unpackbits(raw.reshape(n, BLOCK, lane), axis=2, bitorder="little")
    return np.packbits(bits[:, :, :w].reshape(n, BLOCK * w), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, w: int) -> np.ndarray:
    n, lane = len(packed), _lane(w)
    if w < 8 * lane:
        bits = np.zeros((n, BLOCK, 8 * lane), np.uint8)
        bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(n, BLOCK, w)
        packed = np.packbits(bits.reshape(n, -1), axis=1, bitorder="little")
    return packed.view(f"<u{lane}").astype(np.uint32)


def unpack_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at `starts` in raw."""
    heads = [_HEAD.unpack_from(raw, s) for s in starts.tolist()]
    out = np.zeros((len(heads), BLOCK), np.uint32)
    width = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        size = BLOCK * w // 8
        if w:
            packed = np.frombuffer(b"".join(raw[s + _HEAD.size : s + _HEAD.size + size] for s in starts[at].tolist()), np.uint8)
            out[at] = _unpack(packed.reshape(len(at), size), w)
    for b, (low, w, n) in enumerate(heads):
        if n:
            place = int(starts[b]) + _HEAD.size + BLOCK * w // 8
            where = np.frombuffer(raw, "<u2", n, place)
            out[b, where] = np.frombuffer(raw, "<u4", n, place + 2 * n)
        out[b] += np.uint32(low)
    return out.reshape(-1)


class BlockWriter:
    """Writes ids as they come; holds less than one chunk of them."""

    CHUNK = 256 * BLOCK

    def __init__(self, stream):
        self.stream, self.at, self.starts, self.docs, self.total = stream, 0, [], [], 0
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id is None, doc_id or 0, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.CHUNK:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) // BLOCK * BLOCK
        if end and whole < len(ids):
            ids = np.concatenate([ids, np.full(whole + BLOCK - len(ids), ids[-1], ids.dtype)])
            whole = len(ids)
        for i in range(0, whole, self.CHUNK):
            for raw in pack_blocks(ids[i : min(whole, i + self.CHUNK)]):
                self.starts.append(self.at)
                self._put(raw)
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        index = self.at
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(np.array(self.docs, _DOC).tobytes())
        self._put(_FOOTER.pack(index, len(self.starts), len(self.docs), self.total, MAGIC))
        self.stream.close()


class BlockReader:
    """Reads a file of blocks; any range of ids without the blocks before it."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        size = file.size()
        file.seek(size - _FOOTER.size)
        self.index, blocks, docs, self.total, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token blocks")
        file.seek(self.index)
        self.starts = np.frombuffer(file.read(8 * blocks), "<u8").astype(np.int64)
        self.docs = np.frombuffer(file.read(_DOC.itemsize * docs), _DOC)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start up to end of this file."""
        end = min(end, self.total)
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (end - 1) // BLOCK + 1
        begin = int(self.starts[first])
        stop = int(self.starts[last]) if last < len(self.starts) else self.index
        self.file.seek(begin)
        ids = unpack_blocks(self.file.read(stop - begin), self.starts[first:last] - begin)
        return ids[start - first * BLOCK : end - first * BLOCK]

    def documents(self, chunk: int = 1 << 18) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, ids of this file before it, its ids), reading about `chunk` ids at a time."""
        ends = np.cumsum(self.docs["n"].astype(np.int64))
        d, start = 0, 0
        while d < len(self.docs):
            to = max(d + 1, int(np.searchsorted(ends, start + chunk, side="right")))
            ids = self.ids(start, int(ends[to - 1]))
            at = start
            for i in range(d, to):
                n = int(self.docs["n"][i])
                yield (None if self.docs["null"][i] else int(self.docs["id"][i])), at, ids[at - start : at - start + n]
                at += n
            d, start = to, at


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every whole text (null: empty), append end_id, and write the ids in ascending document order.

    Returns the manifest, one row per file: path, n_docs, n_ids, first_id, first_key and nth (place in the order). A
    file is closed once it holds file_ids ids. Documents are dealt by ranges of (id, hash of the text), so ties of an id
    share no task by force; null ids come first, ties are ordered by the hash. Empty documents hold end_id alone; an
    empty table gives an empty manifest.
    """
    C.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, first, path, nth = encoder(tokenizer), None, (None, 0), "", 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in C.batches(parts):
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key")
            for i, (doc_id, raw) in enumerate(zip(ids, encode(batch.column("text").to_pylist()), strict=True)):
                if writer is None:
                    path, stream = C.write_shared(folder, "tokens")
                    writer, first = BlockWriter(stream), (doc_id, keys[i].as_py())
                writer.add(doc_id, np.frombuffer(raw + end, "<u4"))
                if writer.total >= file_ids:
                    yield closed(writer, path, first, nth)
                    writer, nth = None, nth + 1
        if writer is not None:
            yield closed(writer, path, first, nth)

    def closed(writer: BlockWriter, path: str, first: tuple, nth: int) -> pa.RecordBatch:
        writer.close()
        return pa.RecordBatch.from_pydict({"path": [path], "n_docs": [len(writer.docs)], "n_ids": [writer.total], "first_id": pa.array([first[0]], pa.int64()), "first_key": [first[1]], "nth": [nth]})

    return C.cut(rows.mapInArrow(write, "path string, n_docs long, n_ids long, first_id long, first_key long, nth long"), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents as the files hold them: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The driver gathers one row per file, to add up where each file starts.
    """
    C.small_batches(spark)
    files = manifest.orderBy(F.asc_nulls_first("first_id"), "first_key", "nth").select("path", "n_ids").collect()
    bases = np.concatenate([[0], np.cumsum([f.n_ids for f in files])]).tolist()
    schema = "path string, base long"
    places = spark.createDataFrame([(f.path, b) for f, b in zip(files, bases)], schema)
    places = places.repartition(max(1, len(files)))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with C.read_shared(path) as file:
                    out = []
                    for doc_id, at, ids in BlockReader(file).documents():
                        out.append((doc_id, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(out) == 10_000:
                            yield _table(out)
                            out = []
                    if out:
                        yield _table(out)

    return places.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write all documents as token files in the shared folder and return what reading them back gives."""
    spark = docs.sparkSession
    manifest = write_token_files(docs, tokenizer, C.shared_folder(spark, "tokens"), id_col, text_col, end_id, file_ids)
    return read_token_files(spark, manifest)
