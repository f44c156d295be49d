"""Best-fit decreasing packing of token ids into windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _common as C
from codeloom.llm._tokens import encoder

WINDOW = 2048
#: Pieces packed together in one task. Each such shard is packed on its own and leaves at most a few open windows.
SHARD_PIECES = 4096


class CapacityTree:
    """Open windows by remaining capacity: a segment tree over 0..window whose leaves hold the windows with just
    that much room; finds the tightest window that still takes a piece in O(log window)."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, window: int, room: int) -> None:
        self.windows[room].append(window)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(window, its room) of the tightest open window with room for `need`, which leaves the tree."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.windows[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset in it) of each piece. Longest pieces first, equal ones in the order given."""
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found = opened, window
            opened += 1
        at, room = found
        place[i], offset[i] = at, window - room
        if room > n:
            tree.put(at, room - n)
    return place, offset


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text (null: empty), append end_id and cut it into full windows and one shorter piece.

    Returns doc_id, start, length, doc_tokens and ids (unsigned 32-bit little-endian), written to the shared folder.
    An empty document is one piece of end_id. Rows that share an id are documents of their own.
    """
    C.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * window
        for batch in C.batches(parts):
            out: list[tuple] = []
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                raw += end
                for at in range(0, len(raw), step):
                    part = raw[at : at + step]
                    out.append((doc_id, at // 4, len(part) // 4, len(raw) // 4, part))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    return C.cut(rows.mapInArrow(pieces, "doc_id long, start long, length long, doc_tokens long, ids binary"), "pieces")


KEYS = ("doc_id", "start", "length", "ids_crc32", "ids_hash")
#: Copies of one piece that a row stands for while they are dealt.
COPIES = 4096


def assign_windows(pieces: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Give each piece (doc_id, start, length, and any other columns) a sequence_id and an offset there.

    Pieces are dealt by hash to shards of about shard_pieces; each is packed by best-fit decreasing. Equal pieces are
    counted first and numbered, so that their copies spread over the shards like any others. A shard numbers its windows
    from its own number in steps of the number of shards, so ids never meet. Equal input gives equal windows. Padding
    is what the last windows of each shard leave open.
    """
    shards = max(1, -(-pieces.count() // shard_pieces))
    others = list(pieces.columns)
    count = pieces.groupBy(*others).agg(F.count("*").alias("__n"))
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / COPIES))).alias("__part")
    few = count.select(*others, "__n", part)
    copy = F.sequence(F.col("__part") * COPIES, F.least(F.col("__n"), (F.col("__part") + 1) * COPIES) - 1)
    copies = few.select(*others, F.explode(copy).alias("__copy"))
    keys = [c for c in KEYS if c in others]
    dealt = copies.select(*others, F.pmod(F.xxhash64(*keys, "__copy"), F.lit(shards)).cast("long").alias("__shard"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(keys, kind="stable")
        place, offset = best_fit_decreasing(part["length"].to_numpy(), window)
        return part[others].assign(sequence_id=place * shards + part["__shard"].to_numpy(), offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("__shard").applyInPandas(pack, schema)


def sequences(packed: DataFrame, pad_id: int = 0, window: int = WINDOW) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids (binary), the pieces in order of their offsets, padded to
    the window unless the length is a power of two. `packed` has the ids column of token_pieces()."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    missing = F.when(power, F.lit(0)).otherwise(F.lit(window) - F.col("n")).cast("int")
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), missing))
    body = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", F.concat(body, pad).alias("ids"))


def _digests(pieces: DataFrame) -> DataFrame:
    """Pieces without their ids: a digest of them that the result holds, and a hash that tells them apart."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), F.xxhash64("ids").alias("ids_hash"), "doc_tokens")


def write_sequences(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, pad_id: int = 0, window: int = WINDOW, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the padded sequences of all documents as Parquet files in a folder (sequence_id, ids) and return the
    pieces with their place, as pack_documents() does. A piece's ids join it once its place is known."""
    pieces = token_pieces(docs, tokenizer, end_id, window, id_col, text_col)
    packed = C.cut(assign_windows(_digests(pieces), window, shard_pieces), "packed")
    marked = pieces.select("ids", *[F.col(c).alias(f"p_{c}") for c in ("doc_id", "start", "length")], F.crc32("ids").alias("p_ids_crc32"), F.xxhash64("ids").alias("p_ids_hash"))
    marked = marked.dropDuplicates([c for c in marked.columns if c != "ids"])
    same = [F.col("p_doc_id").eqNullSafe(F.col("doc_id")), *(F.col(f"p_{c}") == F.col(c) for c in KEYS[1:])]
    rows = packed.join(marked, reduce(Column.__and__, same)).select("sequence_id", "offset", "length", "ids")
    sequences(rows, pad_id, window).write.parquet(folder)
    return packed.drop("ids_hash")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their place: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset.

    The ids stay in the written pieces; only their digests, taken from them by Spark, travel to the packing. Null and
    empty texts are one piece of end_id; repeated rows are documents of their own; an empty table gives no rows.
    """
    pieces = token_pieces(docs, tokenizer, end_id, window, id_col, text_col)
    return assign_windows(_digests(pieces), window, shard_pieces).drop("ids_hash")
