"""Exact removal of byte strings that occur earlier in the corpus.

A byte goes if a string of LENGTH bytes that covers it also starts earlier. Sorting every suffix would need several
times the disk that the input takes, so suffixes are sampled first, and the sampling depends on content alone: of the
grams (GRAM bytes) inside a string of LENGTH bytes, the one with the smallest hash is its anchor. Equal strings have
equal anchors at equal places, so only strings that share an anchor are ever compared, and an anchor that occurs once
in the corpus settles all strings around it.

    1. scan     anchors of every text; what a batch of texts holds twice is settled there
    2. anchors  by gram: which of the rest occur twice
    3. texts    by document: the bytes around those anchors; equal surroundings in a batch are settled there
    4. strings  by gram: order all strings around equal anchors; all but the first of equal ones are copies
    5. texts    by document: join what is copied and cut it out

Between the steps travel packed arrays, dealt to buckets by gram or document; there are as many buckets as shuffle
partitions, or more where these would get over BUCKET_BYTES of text each. Strings, the bulk of it, travel as Zstandard
frames. Grams are compared by 64-bit hashes, which at worst makes strings meet in vain; strings whose hashes are equal
are compared byte by byte.

A gram that occurs more than HOT times doesn't meet in one bucket: of the strings around it, those that begin at least
SIDE bytes before it are dealt by the gram and the SIDE bytes before it, the others by the gram and the SIDE bytes behind
it, which each of them holds. Equal strings still meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _common as C
from codeloom.llm import _words as W

LENGTH = 100
GRAM = 32
#: Places where the anchor of a string may start.
REACH = LENGTH - GRAM + 1
#: Longest stretch of a text handled at once; the next begins where it ends and shares LENGTH - 1 bytes.
SEGMENT = 4 << 20
#: Bytes of strings that step 4 orders at once; a bucket with more is ordered in slices by gram.
SLICE = 4 << 20
#: Bytes of a bucket's strings that step 4 holds at once; of a larger bucket it goes through the frames again.
HOLD = 64 << 20
#: Bytes of text that a bucket stands for, about.
BUCKET_BYTES = 64 << 20
#: Occurrences from which a gram's strings are dealt by what stands around it, the bytes looked at on each side, and the
#: most such grams, the most frequent ones: eight bytes for each go to every task.
HOT = 20_000
SIDE = (REACH - 1) // 2
MOST_HOT = 1_000_000
#: Zstandard level of the strings between steps 3 and 4.
LEVEL = 1

_PLACE = np.uint64((1 << 24) - 1)
ANCHOR = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("off", "u1"), ("n", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")])
#: What a row of packed data holds: anchors seen once in their batch, anchors known to recur, strings, spans, a text,
#: a frequent gram (with its count in place of a document).
ONCE, AGAIN, STRINGS, SPANS, TEXT, FREQUENT = range(6)
ROW = "bucket int, kind int, doc long, body binary"


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    """pmod(xxhash64(doc), buckets), as Spark has it for a long."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = np.full(len(doc), 42 + 8, np.uint64) + five
        h ^= turn(doc.astype(np.int64).view(np.uint64) * two, 31) * one
        h = turn(h, 27) * one + four
        h ^= h >> np.uint64(33)
        h *= two
        h ^= h >> np.uint64(29)
        h *= three
        h ^= h >> np.uint64(32)
    return np.mod(h.view(np.int64), buckets)


def gram_bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each `size` neighbours, by running minima within blocks from both ends."""
    n = len(x) - size + 1
    padded = np.full(-(-len(x) // size) * size, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Anchors of all strings of LENGTH bytes within the segments between offsets: for each run of strings with one
    anchor its gram, document, first start, the anchor's distance from there, and the number of strings. docs and
    places say where each segment comes from."""
    if len(data) < LENGTH:
        return np.zeros(0, ANCHOR)
    prefix = W.Prefix(data)
    grams = W.mix((prefix.sums[GRAM:] - prefix.sums[:-GRAM]) * prefix.down[: len(data) - GRAM + 1])
    ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(ranked, REACH)
    sizes = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    segment = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(segment)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[segment]
    place = (least[start] & _PLACE).astype(np.int64)
    if not len(place):
        return np.zeros(0, ANCHOR)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    out = np.zeros(len(first), ANCHOR)
    at, seg = start[first], segment[first]
    out["gram"], out["doc"] = grams[place[first]], docs[seg]
    out["start"] = at - offsets[seg] + places[seg]
    out["off"] = place[first] - at
    out["n"] = np.diff(np.append(first, len(place)))
    return out


def recurring(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _packed(kind: int, bucket: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows dealt to their buckets, in the order given within each."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(rows) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(rows))):
        yield int(bucket[a]), kind, 0, rows[a:b].tobytes()


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["bucket", "kind", "doc", "body"])


def _segments(ids: list[int], texts: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of about `most` at a time, with the bounds, document and place of each segment."""
    data, offsets = C.flat(texts)
    parts, docs, places, held = [], [], [], 0
    for doc, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist()):
        for at in range(a, max(b - LENGTH + 1, a), most):
            part = data[at : min(b, at + most + LENGTH - 1)]
            parts.append(part)
            docs.append(doc)
            places.append(at - a)
            held += len(part)
            if held >= most:
                yield np.concatenate(parts), np.cumsum([0, *map(len, parts)]), np.array(docs), np.array(places)
                parts, docs, places, held = [], [], [], 0
    if parts:
        yield np.concatenate(parts), np.cumsum([0, *map(len, parts)]), np.array(docs), np.array(places)


def scan(buckets: int, segment: int = SEGMENT):
    """Step 1. An anchor that recurs in its batch goes on as known to recur, with a mark for its gram: n is 0, and start
    how often it occurs there."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(parts, segment):
            out = []
            for data, offsets, docs, places in _segments(batch.column(0).to_pylist(), batch.column(1), segment):
                found = anchors(data, offsets, docs, places)
                twice = recurring(found["gram"])
                marks = np.zeros(0, ANCHOR)
                if twice.any():
                    grams, count = np.unique(found["gram"][twice], return_counts=True)
                    marks = np.zeros(len(grams), ANCHOR)
                    marks["gram"], marks["start"] = grams, count
                once = np.concatenate([found[~twice], marks])
                out += _packed(ONCE, gram_bucket(once["gram"], buckets), once)
                known = found[twice]
                out += _packed(AGAIN, doc_bucket(known["doc"], buckets), known)
            yield _batch(out)

    return run


def _grouped(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """(bucket, {kind: its rows}) of rows sorted by bucket."""
    now, held = None, {}
    for batch in parts:
        for bucket, kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if bucket != now:
                if now is not None:
                    yield now, held
                now, held = bucket, {}
            held.setdefault(kind, []).append(body)
    if now is not None:
        yield now, held


def keep_recurring(buckets: int, hot: int = HOT):
    """Step 2. Anchors whose gram occurs twice, by document, and the grams that occur more than `hot` times."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(parts):
            once = np.frombuffer(b"".join(held.get(ONCE, [])), ANCHOR)
            grams, at = np.unique(once["gram"], return_inverse=True)
            mark = once["n"] == 0
            count = np.bincount(at, np.where(mark, once["start"], 1), len(grams))
            found = np.concatenate([once[(count[at] > 1) & ~mark], np.frombuffer(b"".join(held.get(AGAIN, [])), ANCHOR)])
            often = [(0, FREQUENT, int(n), g.tobytes()) for g, n in zip(grams[count > hot], count[count > hot])]
            yield _batch(list(_packed(AGAIN, doc_bucket(found["doc"], buckets), found)) + often)

    return run


def _with_texts(parts: Iterator[pa.RecordBatch], kind: int, dtype: np.dtype, most: int = SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(packed rows sorted by document, documents, their texts) of rows sorted by bucket with the packed ones first."""
    now, held, rows, docs, texts, size = None, [], np.zeros(0, dtype), [], [], 0
    for batch in parts:
        for bucket, k, doc, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if bucket != now or size >= most:
                if docs:
                    yield rows, np.array(docs), texts
                    docs, texts, size = [], [], 0
            if bucket != now:
                now, held, rows = bucket, [], None
            if k == kind:
                held.append(body)
                continue
            if rows is None or held:
                rows = np.frombuffer(b"".join(held), dtype)
                rows = rows[np.lexsort((rows["start"], rows["doc"]))]
                held = []
            docs.append(doc)
            texts.append(body)
            size += len(body)
    if docs:
        yield rows, np.array(docs), texts


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of data in a row, and where each begins."""
    begin = np.cumsum(size) - size
    return data[np.arange(int(size.sum())) + np.repeat(start - begin, size)], begin


def _slabs(size: np.ndarray, most: int = SEGMENT) -> Iterator[slice]:
    """Stretches of rows that hold about `most` bytes or a single row."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash of each stretch of data."""
    out = np.zeros(len(start), np.uint64)
    for at in _slabs(size):
        bytes_, begin = _gather(data, start[at], size[at])
        out[at] = W.Prefix(bytes_).span(begin, begin + size[at])
    return out


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of data at a and b hold the same bytes."""
    out = np.ones(len(a), bool)
    for at in _slabs(size):
        x, begin = _gather(data, a[at], size[at])
        y, _ = _gather(data, b[at], size[at])
        if len(x):
            out[at] = np.logical_and.reduceat(x == y, begin)
    return out


def _split(rows: np.ndarray, start: np.ndarray, data: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows and their starts in data, those of hot grams in two parts with what stands around in place of the gram."""
    at = np.minimum(np.searchsorted(hot, rows["gram"]), max(len(hot) - 1, 0))
    often = hot[at] == rows["gram"] if len(hot) else np.zeros(len(rows), bool)
    if not often.any():
        return rows, start
    wide, s = rows[often], start[often]
    off, n = wide["off"].astype(np.int64), wide["n"].astype(np.int64)
    before = np.clip(off - SIDE + 1, 0, n)
    left, right = wide.copy(), wide.copy()
    left["n"] = before
    right["start"], right["off"], right["n"] = right["start"] + before, off - np.minimum(before, off), n - before
    size = np.full(len(wide), GRAM + SIDE)
    left["gram"], right["gram"] = wide["gram"], wide["gram"]
    some = before > 0
    left["gram"][some] = W.mix(wide["gram"][some] ^ _hashes(data, (s + off - SIDE)[some], size[some]))
    rest = n > before
    right["gram"][rest] = W.mix(wide["gram"][rest] + _hashes(data, (s + off)[rest], size[rest]))
    return np.concatenate([rows[~often], left[some], right[rest]]), np.concatenate([start[~often], s[some], (s + before)[rest]])


def surroundings(buckets: int, hot: np.ndarray):
    """Step 3. The bytes of all strings around each recurring anchor, by gram. Of anchors with equal surroundings in
    one batch, the first goes on and the others' bytes are copies."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for rows, docs, texts in _with_texts(parts, AGAIN, ANCHOR):
            order = np.argsort(docs, kind="stable")
            docs, texts = docs[order], [texts[i] for i in order.tolist()]
            at = np.searchsorted(docs, rows["doc"])
            here = (at < len(docs)) & (docs[np.minimum(at, len(docs) - 1)] == rows["doc"])
            rows, at = rows[here], at[here]
            if not len(rows):
                continue
            data = np.frombuffer(b"".join(texts), np.uint8)
            start = np.cumsum([0, *map(len, texts)])[at] + rows["start"]
            size = rows["n"].astype(np.int64) + LENGTH - 1
            whole = _hashes(data, start, size) ^ W.mix(rows["gram"] + rows["off"])
            # Rows are in order of document and start, so the first of equal ones is the earliest.
            _, first, back = np.unique(whole, return_index=True, return_inverse=True)
            copy = np.flatnonzero(first[back] != np.arange(len(rows)))
            of = first[back][copy]
            copy = copy[(size[of] == size[copy]) & _equal(data, start[copy], start[of], np.minimum(size[copy], size[of]))]
            spans = np.zeros(len(copy), SPAN)
            spans["doc"], spans["start"] = rows["doc"][copy], rows["start"][copy]
            spans["end"] = rows["start"][copy] + size[copy]
            out = list(_packed(SPANS, doc_bucket(spans["doc"], buckets), spans))
            left = np.ones(len(rows), bool)
            left[copy] = False
            rows, start = _split(rows[left], start[left], data, hot)
            bucket = gram_bucket(rows["gram"], buckets)
            order = np.lexsort((rows["gram"], bucket))
            rows, start, bucket = rows[order], start[order], bucket[order]
            size = rows["n"].astype(np.int64) + LENGTH - 1
            cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(rows)) if len(rows) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for part in _slabs(size[a:b]):
                    lo, hi = a + part.start, a + part.stop
                    head = np.array([hi - lo], "<u8").tobytes()
                    out.append((int(bucket[a]), STRINGS, 0, pack(head + rows[lo:hi].tobytes() + _gather(data, start[lo:hi], size[lo:hi])[0].tobytes())))
            yield _batch(out)

    return run


def _unpacked(frame: bytes, unpack) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a STRINGS row and their bytes in a row."""
    raw = unpack(frame)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    return np.frombuffer(raw, ANCHOR, n, 8), np.frombuffer(raw, np.uint8, -1, 8 + n * ANCHOR.itemsize)


def copies(rows: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Spans of all strings around the anchors that start earlier too."""
    if not len(rows):
        return np.zeros(0, SPAN)
    n = rows["n"].astype(np.int64)
    size = n + LENGTH - 1
    begin = np.cumsum(size) - size
    order = np.lexsort((rows["start"], rows["doc"]))
    rows, n, begin = rows[order], n[order], begin[order]
    owner = np.repeat(np.arange(len(rows)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[owner] + step
    keys = W.Prefix(data).span(at, at + LENGTH)
    by_key = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[by_key[1:]] = keys[by_key[1:]] == keys[by_key[:-1]]
    before = np.zeros(len(keys), np.int64)
    before[by_key[1:]] = by_key[:-1]
    if not _as_hashed(data, at, owner, again, before):
        again = _by_bytes(data, at)
    open_ = again & ~np.concatenate([[False], again[:-1] & (owner[1:] == owner[:-1])])
    shut = again & ~np.concatenate([again[1:] & (owner[1:] == owner[:-1]), [False]])
    a, b = np.flatnonzero(open_), np.flatnonzero(shut)
    out = np.zeros(len(a), SPAN)
    out["doc"] = rows["doc"][owner[a]]
    out["start"] = rows["start"][owner[a]] + step[a]
    out["end"] = rows["start"][owner[b]] + step[b] + LENGTH
    return out


def _as_hashed(data: np.ndarray, at: np.ndarray, owner: np.ndarray, again: np.ndarray, before: np.ndarray) -> bool:
    """Whether every string that has the hash of the one before it holds its bytes too. Neighbouring strings that have
    neighbouring ones before them are compared as one stretch."""
    t = np.flatnonzero(again)
    if not len(t):
        return True
    p = before[t]
    on = (t[1:] == t[:-1] + 1) & (p[1:] == p[:-1] + 1) & (owner[t[1:]] == owner[t[:-1]]) & (owner[p[1:]] == owner[p[:-1]])
    heads = np.flatnonzero(np.concatenate([[True], ~on]))
    size = np.diff(np.append(heads, len(t))) + LENGTH - 1
    return bool(_equal(data, at[t[heads]], at[p[heads]], size).all())


def _by_bytes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which strings occur before: by their bytes, for the case that two hashes clash."""
    raw, seen, out = data.tobytes(), set(), np.zeros(len(at), bool)
    for i, a in enumerate(at.tolist()):
        string = raw[a : a + LENGTH]
        out[i] = string in seen
        seen.add(string)
    return out


def _sliced(frames: list[bytes]) -> Iterator[np.ndarray]:
    """Copies among the strings of a bucket, some grams at a time. A bucket of more than HOLD bytes is gone through
    several times, and only the strings of some grams are kept each time."""
    unpack = zstandard.ZstdDecompressor().decompress
    total = sum(map(zstandard.frame_content_size, frames))
    rounds = 1 + total // HOLD
    slices = 1 + total // rounds // SLICE
    for turn in range(rounds):
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(slices)]
        for frame in frames:
            rows, data = _unpacked(frame, unpack)
            size = rows["n"].astype(np.int64) + LENGTH - 1
            begin = np.cumsum(size) - size
            part = (rows["gram"] >> np.uint64(40)) % np.uint64(rounds * slices)
            for i in range(slices):
                at = np.flatnonzero(part == turn * slices + i)
                if len(at):
                    held[i].append((rows[at], _gather(data, begin[at], size[at])[0]))
        for i in range(slices):
            if held[i]:
                rows, data = (np.concatenate(x) for x in zip(*held[i]))
                held[i] = []
                yield copies(rows, data)


def compare(buckets: int):
    """Step 4."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(parts):
            spans = np.concatenate([*_sliced(held.get(STRINGS, [])), np.frombuffer(b"".join(held.get(SPANS, [])), SPAN)])
            yield _batch(list(_packed(SPANS, doc_bucket(spans["doc"], buckets), spans)))

    return run


def cut_out(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 5: doc, n_bytes, removed (starts and ends of the maximal removed runs) and the remaining bytes."""
    for rows, docs, texts in _with_texts(parts, SPANS, SPAN):
        first, last = np.searchsorted(rows["doc"], docs, "left").tolist(), np.searchsorted(rows["doc"], docs, "right").tolist()
        removed, kept = [], []
        for a, b, text in zip(first, last, texts):
            runs = []
            if b > a:
                end = np.maximum.accumulate(rows["end"][a:b])
                new = np.concatenate([[True], rows["start"][a + 1 : b] > end[:-1]])
                runs = list(zip(rows["start"][a:b][new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, b - a - 1)].tolist()))
            pieces, at = [], 0
            for s, e in runs:
                pieces.append(text[at:s])
                at = e
            pieces.append(text[at:])
            removed.append([x for run in runs for x in run])
            kept.append(b"".join(pieces))
        arrays = [pa.array(docs), pa.array(list(map(len, texts)), pa.int64()), pa.array(removed, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc", "n_bytes", "removed", "kept"])


def remove_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, removed (starts and ends of removed runs in bytes) and kept (bytes).

    A null text is empty. Rows that share id and text are one document and get the same result; rows that share an id
    alone are ordered by a hash of the text; null ids come after all others. Texts shorter than LENGTH bytes keep all.
    An empty table gives no rows. The driver gathers at most MOST_HOT frequent grams.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"), F.sum(F.octet_length("text").cast("long")).alias("b")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total.b or 0) // BUCKET_BYTES))
    if total.n == total.d:
        texts, back = rows.withColumnRenamed("doc_id", "doc"), None
    else:
        keyed = rows.withColumn("k", F.xxhash64("text"))
        ranks = keyed.select("doc_id", "k").distinct().orderBy(F.asc_nulls_last("doc_id"), "k")
        ranks = C.cut(ranks.withColumn("doc", F.monotonically_increasing_id()), "order")
        left, right = keyed.alias("a"), ranks.alias("b")
        joined = left.join(right, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.k") == F.col("b.k")))
        back = joined.select(F.col("a.doc_id").alias("doc_id"), "doc")
        texts = joined.select("doc", "text").dropDuplicates(["doc"])
    in_bucket = lambda df: df.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    bodies = texts.select(F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(TEXT).alias("kind"), "doc", F.encode("text", "UTF-8").alias("body"))
    found = texts.select("doc", "text").mapInArrow(scan(buckets, segment), ROW)
    found = C.cut(in_bucket(found).mapInArrow(keep_recurring(buckets, hot), ROW), "anchors")
    C.release(spark)
    often = found.where(F.col("kind") == FREQUENT).orderBy(F.desc("doc"), "body").limit(MOST_HOT).select("body").collect()
    grams = np.sort(np.frombuffer(b"".join(bytes(r.body) for r in often), np.uint64))
    anchors_ = found.where(F.col("kind") == AGAIN)
    around = in_bucket(anchors_.unionByName(bodies)).mapInArrow(surroundings(buckets, grams), ROW)
    spans = C.cut(in_bucket(around).mapInArrow(compare(buckets), ROW), "spans")
    del around
    C.drop_table(found)
    C.release(spark)
    out = in_bucket(spans.unionByName(bodies)).mapInArrow(cut_out, "doc long, n_bytes long, removed array<long>, kept binary")
    if back is None:
        return out.withColumnRenamed("doc", "doc_id")
    return back.join(out, "doc").select("doc_id", "n_bytes", "removed", "kept")
