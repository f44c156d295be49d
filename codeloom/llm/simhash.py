"""SimHash near-duplicates: fingerprints, radius search over bit planes, and groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm import _common as C
from codeloom.llm import near_copies as N
from codeloom.llm.graph import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Buckets with more fingerprints are cut into chunks, and each two chunks are compared by a task's group of their own.
CHUNK = 4096
#: Words of members that queries are compared with at a time.
TASKS = 1 << 13
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxh64_intdigest(b" ".join(words), seed)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    n = len(words) - size + 1
    lanes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, n).view(np.uint8).reshape(n, 8)
    if n < 400:
        counts = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint long) of every whole text; null and empty texts have fingerprint 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_fingerprints(rows, "text", size, seed).select("doc_id", "fingerprint")


def with_fingerprints(docs: DataFrame, text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with the column fingerprint; the text itself becomes null."""
    C.small_batches(docs.sparkSession)
    rows = docs.drop("fingerprint")
    place = rows.columns.index(text_col)

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(parts):
            made = [fingerprint((x or "").encode(), size, seed) for x in batch.column(place).to_pylist()]
            batch = batch.set_column(place, batch.schema.field(place), pa.nulls(batch.num_rows, batch.schema.field(place).type))
            yield batch.append_column("fingerprint", pa.array(np.array(made, np.uint64).view(np.int64)))

    return rows.mapInArrow(hashed, T.StructType([*rows.schema.fields, T.StructField("fingerprint", T.LongType())]))


class Planes:
    """Fingerprints stored as bit planes: plane b holds bit b of 64 fingerprints in each word."""

    def __init__(self, prints: np.ndarray):
        self.n = len(prints)
        self.prints = prints
        padded = np.zeros(-(-self.n // 64) * 64, np.uint64)
        padded[: self.n] = prints
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")

    def near(self, queries: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in queries, member) of all pairs at most `radius` bits apart: each query against one word of members,
        of which those in the mask `lanes` count.

        Each plane is compared with one bit of each query; the differing bits go into carry-save counters, one bit of
        the count to a word, and into a mask of members that are over the radius. Every few planes, words whose
        members are all over are abandoned.
        """
        active = np.flatnonzero(lanes)
        over = ~lanes[active]
        depth = (radius + 1).bit_length()
        counters = np.zeros((depth, len(active)), np.uint64)
        for b in range(64):
            flip = np.where(queries[active] >> np.uint64(b) & np.uint64(1), _FULL, np.uint64(0))
            carry = (self.planes[b][word[active]] ^ flip) & ~over
            for level in range(depth):
                counters[level], carry = counters[level] ^ carry, counters[level] & carry
            reached = carry
            for level in range(depth):
                same = _FULL if (radius + 1) >> level & 1 else np.uint64(0)
                equal = ~(counters[level] ^ same) if not level else equal & ~(counters[level] ^ same)
            over |= reached | equal
            if b % 6 == 5:
                alive = over != _FULL
                if not alive.all():
                    active, over, counters = active[alive], over[alive], counters[:, alive]
                    if not len(active):
                        break
        at, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return active[at], word[active[at]] * 64 + lane

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of all pairs at most `radius` bits apart."""
        words = self.planes.shape[1]
        q, word = np.repeat(np.arange(len(queries)), words), np.tile(np.arange(words), len(queries))
        at, member = self.near(queries[q], word, _lanes(0, self.n - 64 * word), radius)
        return q[at], member

    def pairs(self, end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (a, b) at most `radius` bits apart with a < b < end[a]: the members of a's group behind it. Groups
        follow one another in the same planes, so a word may hold several, and large ones fill many words."""
        row = np.arange(self.n)
        words = (end - 1) // 64 - row // 64 + 1
        last = np.cumsum(words)
        at = 0
        while at < self.n:
            to = max(at + 1, int(np.searchsorted(last, (last[at - 1] if at else 0) + TASKS, side="right")))
            q = np.repeat(row[at:to], words[at:to])
            word = q // 64 + np.arange(len(q)) - np.repeat(np.cumsum(words[at:to]) - words[at:to], words[at:to])
            found, b = self.near(self.prints[q], word, _lanes(q + 1 - 64 * word, end[q] - 64 * word), radius)
            if len(found):
                yield q[found], b
            at = to


def _lanes(start, end) -> np.ndarray:
    """Masks with the bits from start up to end, both of which may lie outside 0..64."""
    below = lambda n: np.where(n >= 64, _FULL, (np.uint64(1) << np.clip(n, 0, 63).astype(np.uint64)) - np.uint64(1))
    return below(np.asarray(end)) & ~below(np.broadcast_to(start, np.shape(end)))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member reachable from each of 0..n-1 over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def masks(radius: int, blocks: int) -> list[int]:
    """Bit masks such that two codes within the radius agree on at least one: all choices of blocks - radius blocks."""
    size = 64 // blocks
    return [sum(((1 << size) - 1) << (size * b) for b in kept) for kept in combinations(range(blocks), blocks - radius)]


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints: a spanning forest of those within the radius in each bucket.

    Two fingerprints within the radius agree on at least two of radius + 2 blocks, so each is dealt to one bucket per
    choice of two blocks. Larger buckets than CHUNK are cut by hash into chunks whose pairs are dealt out apart.
    """
    unsigned = [m - (1 << 64) if m >> 63 else m for m in masks(radius, radius + 2)]
    tables = F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")) for m in unsigned])).alias("t", "k")
    keyed = C.cut(prints.select("fingerprint", tables), "buckets")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    rows = keyed.join(sizes, ["t", "k"]).withColumn("c", chunks).withColumn("mine", F.pmod(F.xxhash64("fingerprint"), F.col("c")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other")
    rows = rows.select("t", "k", "fingerprint", "mine", other).withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))
    dealt = rows.repartition("t", "k", "x", "y").sortWithinPartitions("t", "k", "x", "y", "fingerprint")
    dealt = dealt.select(F.xxhash64("t", "k", "x", "y").alias("g"), "fingerprint")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, prints in _whole_groups(parts):
            a, b = _links(group, prints, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(prints[a].view(np.int64)), pa.array(prints[b].view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def _whole_groups(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted rows in pieces that hold whole groups."""
    kept_g, kept_p = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in parts:
        g = np.concatenate([kept_g, batch.column(0).to_numpy(zero_copy_only=False)])
        p = np.concatenate([kept_p, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(g):
            continue
        last = len(g) - int(np.argmax(g[::-1] != g[-1])) if (g != g[-1]).any() else 0
        if last and last >= 20_000 or last and len(g) - last > CHUNK:
            yield g[:last], p[:last]
            g, p = g[last:], p[last:]
        kept_g, kept_p = g, p
    if len(kept_g):
        yield kept_g, kept_p


def _links(group: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (member, smallest member) of the links within each group of adjacent rows. Links are settled
    as they are found: a group whose members are all near one another holds far more of them than members."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    label = np.arange(len(group))
    for a, b in Planes(prints).pairs(np.repeat(starts + sizes, sizes), radius):
        apart = label[a] != label[b]
        if apart.any():
            label = forest(len(group), label[a[apart]], label[b[apart]])[label]
    linked = np.flatnonzero(label != np.arange(len(group)))
    return linked, label[linked]


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, root, component_id) of each distinct fingerprint: the smallest fingerprint and the smallest
    doc_id that links reach."""
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    linked = components(near_links(distinct, radius))
    nodes = distinct.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    nodes = nodes.withColumn("root", F.coalesce("component", "fingerprint"))
    first = nodes.where("component is not null").groupBy("root").agg(F.min("least").alias("first"))
    component = F.when(F.col("component").isNotNull(), F.col("first")).otherwise(F.col("least"))
    return nodes.join(first, "root", "left").select("fingerprint", "root", component.alias("component_id"), "least")


def _done(spark: SparkSession, known: int, *names: str) -> None:
    """Delete this thread's tables of some names that came after the first `known`, and what shuffles left of them."""
    C.delete_folders(spark, [f for f in C.folders()[known:] if any(f"/{n}-" in f for n in names)])
    C.release(spark)


def one_of_each(docs: DataFrame, text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, one for each group of near copies: pairs of a five-word Jaccard similarity of 0.8
    or more are near, and groups are what such pairs join. The one with the smallest doc_id stays (of a group of null
    ids one with the smallest set of shingles by hash; of repeated rows one). Texts without words are one group; an
    empty table gives no rows; columns of docs may have any other names.

    SimHash links sets whose fingerprints lie within the radius. Any radius leaves some pairs of that similarity apart,
    so sets that share one of their rarest shingles are linked as well, which misses none. All that is linked is
    verified on whole sets.
    """
    spark = docs.sparkSession
    known = len(C.folders())
    key = F.xxhash64("doc_id", text_col)
    narrow = docs.select("doc_id", F.col(text_col).alias("text"), key.alias("key"))
    marked = C.cut(N.with_sets(narrow), "sets")
    distinct = marked.groupBy("s").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.min("key").alias("key"), F.first("fingerprint").alias("fingerprint"))
    distinct = C.cut(distinct, "distinct")
    prints = distinct.groupBy("fingerprint").agg(F.min("s").alias("a"), F.count("*").alias("k"))
    equal = distinct.join(prints.where("k > 1"), "fingerprint").where("s <> a").select("a", F.col("s").alias("b"))
    close = near_links(prints.select("fingerprint"), radius)
    of = lambda end: prints.select(F.col("fingerprint").alias(end), F.col("a").alias(f"s_{end}"))
    close = close.distinct().join(of("a"), "a").join(of("b"), "b").select(F.col("s_a").alias("a"), F.col("s_b").alias("b"))
    near = C.cut(components(N.rare_links(narrow, distinct.select("s", "n")).unionByName(equal).unionByName(close)), "candidates")
    del equal, close, prints
    _done(spark, known, "shingles", "prefixes", "buckets", "edges")
    chosen = distinct.select("s", "key").join(near.withColumnRenamed("node", "s"), "s")
    texts = C.cut(narrow.select("key", "text").join(chosen, "key").dropDuplicates(["s"]).select("s", "component", "text"), "candidate-texts")
    del chosen
    C.release(spark)
    linked = C.cut(components(N.verified(texts)), "components")
    _done(spark, known, "candidate-texts", "candidates", "edges")
    nodes = distinct.join(linked.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("component", "s"))
    stay = nodes.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "s")).alias("m")).select("m.s", "m.least")
    met = marked.join(stay, "s").where(F.col("doc_id").eqNullSafe(F.col("least")))
    keys = met.groupBy("s").agg(F.min("key").alias("key"), F.first("least").alias("least")).select("key", "least")
    # Dealt by a hash of id and text, which no group makes hot, and the texts only once.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), key.alias("key"))
    kept = rows.join(keys, "key").where(F.col("id").eqNullSafe(F.col("least"))).dropDuplicates(["key", "id"])
    return kept.select("row.*")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (long) and component_id, the smallest doc_id that links reach.

    Documents with equal fingerprints, those without words included, are linked like any others. A null id is never
    the smallest; a component whose ids are all null has component_id null. Repeated rows keep their places; an empty
    table gives no rows. Distinct fingerprints alone are compared and joined into components; documents then take
    their fingerprint's component.
    """
    prints = C.cut(fingerprints(docs, id_col, text_col, size, seed), "fingerprints")
    nodes = groups(prints.select("fingerprint", "doc_id"), radius).select("fingerprint", "component_id")
    return prints.join(nodes, "fingerprint").select("doc_id", "fingerprint", "component_id")
