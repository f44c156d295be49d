"""The similarity that operator 9's pipeline stage stands for: exact Jaccard of five-word shingles.

SimHash finds pairs within its radius; what lies further apart is met here by a prefix-filtered set join, and every
pair that either way meets is verified.

Two sets of similarity 0.8 or more share a member among the rarest of each: the first n - ceil(0.8 n) + 1 of its n
shingles, ordered by the number of sets that hold them. So no pair is missed, whatever the order, and every pair that
meets is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm import _common as C
from codeloom.llm import _words as W

SHINGLE = 5
#: Least similarity, as a fraction: numerator and denominator.
LEAST = (4, 5)
#: Hash ranges in which shingles are counted, at least, and bytes (sixteen for each shingle of each set) that a range
#: and that a task holds, about: a larger corpus is dealt to more of both.
PACKS = 1024
PACK_BYTES = 8 << 20
TASK_BYTES = 64 << 20
#: Candidate groups with more sets are cut into chunks, and each two chunks are compared by a task's group of their own.
CHUNK = 2048
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word shingles of each row, in order; a row of fewer words has one shingle of all."""
    data = _LOWER[data]
    start, end, row = W.bounds(data, offsets)
    words = W.Prefix(data).span(start, end)
    first, hashes = W.windows(words, row, size)
    rows, found = [row[first]], [hashes]
    n = np.bincount(row, minlength=len(offsets) - 1)
    for short in range(1, size):
        mine = n[row] == short
        first, hashes = W.windows(words[mine], row[mine], short)
        rows.append(row[mine][first])
        found.append(W.mix(hashes + np.uint64(short)))
    row, found = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return row[new], found[new]


def set_ids(row: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, size) of each row's set of shingles: equal sets have equal ids; the empty set has id 0."""
    sums = np.zeros(len(row) + 1, np.uint64)
    np.cumsum(W.mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
    ends = np.searchsorted(row, np.arange(rows + 1))
    return W.mix(sums[ends[1:]] - sums[ends[:-1]]), np.diff(ends)


def set_prints(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """The 64-bit SimHash of each row's set of shingles: a bit is 1 if set in over half of its hashes."""
    out = np.zeros(rows, np.uint64)
    some, start = np.unique(row, return_index=True)
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
        n = np.diff(np.append(start, len(row)))
        out[some] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def with_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, key, s, n, fingerprint) of rows (doc_id, key, text): id, size and SimHash of the text's set of shingles."""
    C.small_batches(docs.sparkSession)

    def made(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(parts, W.BATCH):
            row, h = shingles(*C.flat(batch.column(2)))
            ids, n = set_ids(row, h, batch.num_rows)
            made_ = [ids.view(np.int64), n.astype(np.int64), set_prints(row, h, batch.num_rows).view(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, made_)], names)

    names = ["doc_id", "key", "s", "n", "fingerprint"]
    kinds = [docs.schema["doc_id"], docs.schema["key"], *(T.StructField(c, T.LongType()) for c in names[2:])]
    return docs.select("doc_id", "key", "text").mapInArrow(made, T.StructType(kinds))


def shared_shingles(docs: DataFrame, total: int) -> DataFrame:
    """(s, h, df) of each set's shingles that df > 1 different sets hold; total: shingles of all different sets."""
    packs = 1 << max(PACKS, total * 16 // PACK_BYTES).bit_length() - 1
    shift = np.uint64(65 - packs.bit_length())
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * 16 // TASK_BYTES))

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(parts, W.BATCH):
            row, h = shingles(*C.flat(batch.column(0)))
            ids, _ = set_ids(row, h, batch.num_rows)
            pack = (h >> shift).astype(np.int32)
            order = np.argsort(pack, kind="stable")
            pack, both = pack[order], np.stack([h, ids[row]], axis=1)[order]
            cuts = np.flatnonzero(np.diff(pack, prepend=-1))
            ends = np.append(cuts[1:], len(pack))
            yield pa.RecordBatch.from_arrays([pa.array(pack[cuts]), pa.array([both[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist())], pa.binary())], ["pack", "both"])

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in parts:
            for pack, both in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if pack != at:
                    yield from _shared(held)
                    at, held = pack, []
                held.append(both)
        yield from _shared(held)

    rows = docs.select("text").mapInArrow(packed, "pack int, both binary")
    return rows.repartition(tasks, "pack").sortWithinPartitions("pack").mapInArrow(counted, "s long, h long, df long")


def _shared(held: list[bytes]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    h, s = np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2).T
    order = np.lexsort((s, h))
    h, s = h[order], s[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    h, s = h[new], s[new]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    df = np.diff(np.append(starts, len(h)))
    several = np.repeat(df > 1, df)
    columns = [s[several].view(np.int64), h[several].view(np.int64), np.repeat(df, df)[several].astype(np.int64)]
    for at in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in columns], ["s", "h", "df"])


def prefix(n):
    """How many of n shingles, rarest first, two sets of similarity LEAST or more share one of; at least 1."""
    a, b = LEAST
    return n - (a * n + b - 1) // b + 1


def rare_links(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links (a, b) between sets that share a prefix shingle. `sizes` has (s, n) of each distinct set."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shared = C.cut(shared_shingles(docs, total), "shingles")
    C.release(docs.sparkSession)
    a, b = LEAST
    # Shingles of one set alone are rarest: only what they leave of the prefix can meet another set.
    alone = F.col("n") - F.col("k")
    room = F.col("n") - F.floor((a * F.col("n") + b - 1) / b) + 1 - alone
    few = shared.groupBy("s").agg(F.count("*").alias("k")).join(sizes, "s").select("s", room.cast("int").alias("room")).where("room > 0")
    mine = shared.join(few, "s").groupBy("s", "room").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("found"))
    met = C.cut(mine.select("s", F.explode(F.slice("found", F.lit(1), F.col("room"))).alias("x")).select("s", F.col("x.h").alias("h")), "prefixes")
    least = met.groupBy("h").agg(F.min("s").alias("a"), F.count("*").alias("k")).where("k > 1").select("h", "a")
    return met.join(least, "h").where("s <> a").select("a", F.col("s").alias("b"))


def verified(sets: DataFrame) -> DataFrame:
    """Links (a, b) between set ids of rows (s, component, text): a spanning forest of the pairs of similarity LEAST or
    more in each two chunks of a component."""
    chunks = sets.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("c"))
    rows = sets.join(chunks, "component").withColumn("mine", F.pmod(F.xxhash64("s"), F.col("c")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.select("component", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "s", "text")

    def compare(table: pa.Table) -> pa.Table:
        s = table.column("s").to_numpy()
        owner, h = [], []
        at = 0
        for batch in C.batches(iter(table.select(["text"]).to_batches()), W.BATCH):
            r, x = shingles(*C.flat(batch.column(0)))
            owner.append(r + at)
            h.append(x)
            at += batch.num_rows
        a, b = links(np.concatenate(owner), np.concatenate(h), len(s))
        return pa.table({"a": s[a], "b": s[b]})

    return rows.groupBy("component", "x", "y").applyInArrow(compare, "a long, b long")


def links(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets 0..n-1 of similarity LEAST or more, enough to join whatever all of them join."""
    _, code, df = np.unique(h, return_inverse=True, return_counts=True)
    ends = np.searchsorted(owner, np.arange(n + 1))
    index: dict[int, list[int]] = {}
    label = np.arange(n)
    members = [[i] for i in range(n)]
    a, b = LEAST
    out = []
    for i in range(n):
        mine = code[ends[i] : ends[i + 1]]
        rare = mine[np.lexsort((mine, df[mine]))][: prefix(len(mine))]
        rare = rare[df[rare] > 1].tolist()
        met = set().union(*(index.get(x, ()) for x in rare))
        for j in sorted(met):
            if label[j] == label[i]:
                continue
            theirs = code[ends[j] : ends[j + 1]]
            small, large = sorted((len(mine), len(theirs)))
            if b * small < a * large:
                continue
            both = len(np.intersect1d(mine, theirs, assume_unique=True))
            if b * both >= a * (small + large - both):
                out.append((j, i))
                keep, gone = label[j], label[i]
                if len(members[keep]) < len(members[gone]):
                    keep, gone = gone, keep
                label[members[gone]] = keep
                members[keep] += members[gone]
                members[gone] = []
        for x in rare:
            index.setdefault(x, []).append(i)
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]
