"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact cosine at the end.

A rotation is learned on a bounded sample so that the signs of the rotated vectors make balanced 64-bit codes. A code
is cut into four tables of 16 bits; it stands in the bucket of its own 16 bits and of all that differ in one bit, so
two codes meet wherever any table differs in at most two bits. Only codes are dealt to the buckets, each distinct one
once. Pairs of codes that meet and differ in at most FAR bits are reranked: their vectors are fetched and compared by
cosine in double precision. A pair that meets in several buckets counts in one of them, which both codes name.

Equal vectors are one vector with a multiplicity throughout, told apart by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _common as C
from codeloom.llm import _words as W
from codeloom.llm.graph import components
from codeloom.llm.simhash import forest

BITS = 64
TABLES = 4
WIDTH = BITS // TABLES
LEAST = 0.95
#: Vectors that the rotation is learned on: those with the smallest seeded hashes.
SAMPLE_ROWS = 4_000
ITERATIONS = 40
SEED = 23
#: Buckets above this size are cut into chunks; each two chunks are compared apart.
CHUNK = 1024
#: The same for codes of more vectors than this, which are compared in full.
UNIT = 256
#: Most bits that reranked codes differ in. Pairs of cosine 0.95 differ in 6.5 of 64 on average, with a standard
#: deviation of 2.4.
FAR = 14
#: Bytes of dealt codes that one task gathers, about.
BUCKET_BYTES = 64 << 20


def learn_rotation(sample: np.ndarray, seed: int = SEED, iterations: int = ITERATIONS) -> np.ndarray:
    """Projection from the vectors' space to BITS signs: principal directions, then the rotation that brings the
    sample closest to its signs. Spaces of fewer dimensions are first spread over BITS random directions."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    if d >= BITS:
        values, vectors = np.linalg.eigh(sample.T @ sample) if len(sample) else (None, np.eye(d))
        base = vectors[:, ::-1][:, :BITS]
    else:
        base = np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-BITS // d))], axis=1)[:, :BITS]
    rotation = np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
    flat = sample @ base
    for _ in range(iterations if len(sample) else 0):
        signs = np.where(flat @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(flat.T @ signs)
        rotation = u @ v
    return base @ rotation


def encode(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    bits = (vectors @ rotation) >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def counted_here(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a pair of codes counts in the bucket `key`: the smallest bucket of the first table that they share."""
    x = a ^ b
    chosen = np.full(len(x), -1, np.int64)
    mask = np.uint64((1 << WIDTH) - 1)
    for t in range(TABLES - 1, -1, -1):
        shift = np.uint64(t * WIDTH)
        p, q = (a >> shift & mask).astype(np.int64), (b >> shift & mask).astype(np.int64)
        d = p ^ q
        n = np.bitwise_count(d.astype(np.uint64))
        low = d & -d
        top = np.where(p > 0, 1 << np.floor(np.log2(np.maximum(p, 1))).astype(np.int64), 0)
        least = np.where(n == 0, p ^ top, np.where(n == 1, np.minimum(p, q), np.minimum(p ^ low, p ^ d ^ low)))
        chosen = np.where(n <= 2, (t << WIDTH) + least, chosen)
    return chosen == key


def _unit(raw: np.ndarray) -> np.ndarray:
    v = raw / np.abs(raw).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def pairs_in_groups(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of rows of one group, in parts. Rows of a group are adjacent; side is 0 where all pairs count, and
    1 or 2 where only pairs of both sides do."""
    at = np.arange(len(group))
    for lag in range(1, len(group)):
        at = at[: np.searchsorted(at, len(group) - lag)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            return
        ok = (side[at] == 0) | (side[at] != side[at + lag])
        yield at[ok], at[ok] + lag


def keys_of(codes: np.ndarray) -> np.ndarray:
    """The buckets of each code: table and 16 bits, those that differ in one bit included."""
    flips = np.array([0, *(1 << i for i in range(WIDTH))], np.uint64)
    mask = np.uint64((1 << WIDTH) - 1)
    own = [(codes >> np.uint64(t * WIDTH) & mask)[:, None] ^ flips | np.uint64(t << WIDTH) for t in range(TABLES)]
    return np.concatenate(own, axis=1).astype(np.uint32)


def hot_keys(book: DataFrame) -> dict[tuple[int, int], int]:
    """Number of chunks of each bucket (length of the vectors, key) with more than CHUNK codes. Tasks send arrays of
    counts, of which there are TABLES * 2**WIDTH for each length; no more rows than that come to the driver."""
    part = 1 << 12

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, np.ndarray] = {}
        for batch in parts:
            d, c = (batch.column(i).to_numpy() for i in (0, 1))
            for size in np.unique(d).tolist():
                held = n.setdefault(size, np.zeros(TABLES << WIDTH, np.int64))
                held += np.bincount(keys_of(c[d == size].view(np.uint64)).reshape(-1), minlength=len(held))
        for size, held in n.items():
            cells = held.reshape(-1, part)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), size, np.int32)), pa.array(np.arange(len(cells), dtype=np.int32)), pa.array([x.tobytes() for x in cells], pa.binary())], ["d", "part", "n"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(part, np.int64)
        for batch in parts:
            for key, raw in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                if key != now:
                    yield from large(now, held)
                    now, held = key, np.zeros(part, np.int64)
                held += np.frombuffer(raw, np.int64)
        yield from large(now, held)

    def large(key: tuple[int, int] | None, held: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(held > CHUNK)
        if key is not None and len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key[0], np.int32)), pa.array((at + key[1] * part).astype(np.int32)), pa.array(-(-held[at] // CHUNK))], ["d", "key", "c"])

    sums = book.select("d", "code").mapInArrow(count, "d int, part int, n binary").repartition("d", "part").sortWithinPartitions("d", "part")
    return {(x.d, x.key): x.c for x in sums.mapInArrow(add, "d int, key int, c long").collect()}


ENTRY = np.dtype([("d", "<i4"), ("key", "<u4"), ("x", "<u4"), ("y", "<u4"), ("side", "u1"), ("code", "<u8")])


def entries(d: int, codes: np.ndarray, hot: dict[tuple[int, int], int]) -> np.ndarray:
    """Where the codes are dealt: once for each of their buckets, and in a bucket of several chunks once for each
    chunk that theirs is compared with."""
    keys = keys_of(codes)
    out = np.zeros(keys.size, ENTRY)
    out["d"], out["key"], out["code"] = d, keys.reshape(-1), np.repeat(codes, keys.shape[1])
    table = np.zeros(TABLES << WIDTH, np.int64)
    for (size, key), c in hot.items():
        if size == d:
            table[key] = c
    chunks = table[out["key"]]
    if not chunks.any():
        return out
    cold, out, chunks = out[chunks == 0], out[chunks > 0], chunks[chunks > 0]
    mine = ((out["code"] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % chunks
    rows = np.repeat(np.arange(len(out)), chunks)
    other = np.arange(len(rows)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    out, mine = out[rows], mine[rows]
    out["x"], out["y"] = np.minimum(mine, other), np.maximum(mine, other)
    out["side"] = np.where(mine == other, 0, np.where(mine < other, 1, 2))
    return np.concatenate([cold, out])


_FIELDS = ("d", "key", "x", "y", "side", "code")


def _packed(rows: np.ndarray) -> bytes:
    """Field by field, so that equal and near values stand together."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(rows[f].tobytes() for f in _FIELDS))


def _unpacked(raw: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    out, at = np.zeros(len(raw) // ENTRY.itemsize, ENTRY), 0
    for f in _FIELDS:
        out[f] = np.frombuffer(raw, ENTRY[f], len(out), at)
        at += len(out) * ENTRY[f].itemsize
    return out


def near_codes(book: DataFrame) -> DataFrame:
    """(d, a, b): pairs of different codes that meet and differ in at most FAR bits, each once."""
    spark = book.sparkSession
    hot = spark.sparkContext.broadcast(hot_keys(book))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-book.count() * TABLES * (WIDTH + 1) * 12 // BUCKET_BYTES))

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            d, c = (batch.column(i).to_numpy() for i in (0, 1))
            rows = np.concatenate([entries(size, c[d == size].view(np.uint64), hot.value) for size in np.unique(d).tolist()] or [np.zeros(0, ENTRY)])
            g = W.mix(W.mix(rows["d"].astype(np.uint64) << np.uint64(32) | rows["key"]) + (rows["x"].astype(np.uint64) << np.uint64(32) | rows["y"]))
            b = (g % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((rows["y"], rows["x"], rows["key"], rows["d"], b))
            rows, b = rows[order], b[order]
            cuts = np.flatnonzero(np.diff(b, prepend=-1))
            ends = np.append(cuts[1:], len(b))
            yield pa.RecordBatch.from_arrays([pa.array(b[cuts].astype(np.int32)), pa.array([_packed(rows[i:j]) for i, j in zip(cuts.tolist(), ends.tolist())], pa.binary())], ["bucket", "body"])

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in parts:
            for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now:
                    yield from met(held)
                    now, held = bucket, []
                held.append(_unpacked(body))
        yield from met(held)

    def met(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows["y"], rows["x"], rows["key"], rows["d"]))]
        new = np.zeros(len(rows), bool)
        for f in ("d", "key", "x", "y"):
            new[1:] |= rows[f][1:] != rows[f][:-1]
        code, key, d = rows["code"].copy(), rows["key"].astype(np.int64), rows["d"]
        for a, b in pairs_in_groups(np.cumsum(new), rows["side"]):
            near = np.bitwise_count(code[a] ^ code[b]) <= FAR
            a, b = a[near], b[near]
            here = counted_here(key[a], code[a], code[b])
            if here.any():
                x, y = code[a[here]], code[b[here]]
                yield pa.RecordBatch.from_arrays([pa.array(d[a[here]]), pa.array(np.minimum(x, y).view(np.int64)), pa.array(np.maximum(x, y).view(np.int64))], ["d", "a", "b"])

    dealt = book.select("d", "code").mapInArrow(deal, "bucket int, body binary")
    return dealt.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, "d int, a long, b long")


def units(book: DataFrame, near: DataFrame) -> DataFrame:
    """(u, side, d, code, chunk): what is reranked together: for each pair of codes, and for each code of several
    vectors with itself, each two chunks of their vectors."""
    chunks = book.select("d", "code", F.ceil(F.col("k") / UNIT).cast("int").alias("c"))
    own = book.where("k > 1").select("d", F.col("code").alias("a"), F.col("code").alias("b"))
    of = lambda end: chunks.select("d", F.col("code").alias(end), F.col("c").alias(f"c_{end}"))
    rows = near.unionByName(own).join(of("a"), ["d", "a"]).join(of("b"), ["d", "b"])
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("c_a") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c_b") - 1)))
    rows = rows.where("a <> b or i <= j").withColumn("u", F.xxhash64("d", "a", "b", "i", "j"))
    whole = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    left = F.struct(F.when(whole, 0).otherwise(1).alias("side"), F.col("a").alias("code"), F.col("i").alias("chunk"))
    right = F.struct(F.lit(2).alias("side"), F.col("b").alias("code"), F.col("j").alias("chunk"))
    return rows.select("u", "d", F.explode(F.when(whole, F.array(left)).otherwise(F.array(left, right))).alias("x")).select("u", "d", "x.*")


def reranked(rows: DataFrame, least: float) -> DataFrame:
    """(a, n, b) of rows (u, side, r, m, v): links of each vector within a unit, counted with the others'
    multiplicities, and the smallest vector that links reach there."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(parts):
            u, side, r, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            size = pc.list_value_length(batch.column(4)).to_numpy()
            values = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            a_all, b_all = [], []
            vectors = {d: _unit(values[begin[size == d][:, None] + np.arange(d)].astype(np.float64)) for d in np.unique(size).tolist()}
            place = np.zeros(len(u), np.int64)
            for d in vectors:
                place[size == d] = np.arange(int((size == d).sum()))
            for a, b in pairs_in_groups(u, side):
                for d, x in vectors.items():
                    at = size[a] == d
                    p, q = a[at], b[at]
                    ok = np.einsum("ij,ij->i", x[place[p]], x[place[q]]) >= least
                    a_all.append(p[ok])
                    b_all.append(q[ok])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_all, b_all))
            n = np.bincount(a, m[b], len(u)) + np.bincount(b, m[a], len(u))
            label = forest(len(u), a, b)
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(r[some]), pa.array(n[some].astype(np.int64)), pa.array(r[label[some]])], ["a", "n", "b"])

    return rows.mapInArrow(compare, "a long, n long, b long")


def near_vectors(table: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of the table: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of
    different lengths never link. Repeated rows are vectors of their own and link with each other; of rows that share
    the smallest id of a component all are kept. A null id is never the smallest; a component of null ids alone has
    component_id null and is not kept. An empty table gives no rows. The rotation is learned on at most `sample_rows`
    vectors, those with the smallest seeded hashes; every vector is coded, dealt and looked up.
    """
    C.small_batches(table.sparkSession)
    kind = table.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"), F.monotonically_increasing_id().alias("r"))
    rows = C.cut(rows, "vectors")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = rows.where("v is not null and size(v) > 0").where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    taken = usable.orderBy(F.xxhash64(F.lit(SEED), "vec_id", "v"), "r").limit(sample_rows).select("v").collect()
    by_size: dict[int, list] = {}
    for x in taken:
        by_size.setdefault(len(x.v), []).append(x.v)
    learned = {d: learn_rotation(_unit(np.array(x, np.float64))) for d, x in by_size.items()}

    def code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sizes = batch.column(2).to_numpy()
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                if d not in learned:
                    learned[d] = learn_rotation(np.zeros((0, d)))
                c = encode(_unit(values[(ends[at] - d)[:, None] + np.arange(d)].astype(np.float64)), learned[d]).view(np.int64)
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), pa.array(np.full(len(at), d, np.int32)), pa.array(c), batch.column(3).take(pick), batch.column(4).take(pick)], ["r", "d", "code", "h", "h2"])

    coded = usable.select("r", "v", F.size("v").alias("n"), F.xxhash64("v").alias("h"), F.xxhash64(F.lit(SEED), "v").alias("h2"))
    codes = C.cut(coded.mapInArrow(code, "r long, d int, code long, h long, h2 long"), "vector-codes")
    distinct = C.cut(codes.groupBy("d", "h", "h2").agg(F.min("r").alias("rep"), F.count("*").alias("m"), F.first("code").alias("code")), "distinct-vectors")
    book = C.cut(distinct.groupBy("d", "code").agg(F.count("*").alias("k")), "codes")
    near = C.cut(near_codes(book), "near-codes")
    chunk = F.pmod(F.xxhash64("rep"), F.ceil(F.col("k") / UNIT)).cast("int").alias("chunk")
    members = distinct.join(book, ["d", "code"]).select("d", "code", chunk, F.col("rep").alias("r"), "m")
    wanted = units(book, near).join(members, ["d", "code", "chunk"]).select("u", "side", "r", "m")
    dealt = wanted.join(rows.select("r", "v"), "r").select("u", "side", "r", "m", "v").repartition("u").sortWithinPartitions("u", "side", "r")
    linked = C.cut(reranked(dealt, least), "vector-links")
    counts = linked.groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(linked.select("a", "b")).withColumnRenamed("component", "root")
    reps = distinct.join(counts, distinct["rep"] == counts["a"], "left").join(roots, F.col("rep") == F.col("node"), "left")
    reps = reps.select("d", "h", "h2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    mine = codes.select("r", "d", "h", "h2").join(reps, ["d", "h", "h2"]).select(F.col("r").alias("a"), "n_links", "component")
    out = rows.select("vec_id", "r").join(mine, F.col("r") == F.col("a"), "left")
    least_id = out.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("first"))
    out = out.join(least_id, "component", "left")
    first = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("first"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), first.alias("component_id"), F.coalesce(F.col("vec_id") == first, F.lit(False)).alias("kept"))


def _whole_groups(parts: Iterator[pa.RecordBatch], least: int = 8192) -> Iterator[pa.RecordBatch]:
    """Sorted rows in pieces that hold whole groups (column 0)."""
    held: list[pa.RecordBatch] = []
    for batch in parts:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        g = batch.column(0).to_numpy(zero_copy_only=False)
        differs = np.flatnonzero(g != g[-1])
        if not len(differs):
            continue
        cut = int(differs[-1]) + 1
        yield _joined([*held[:-1], batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]
