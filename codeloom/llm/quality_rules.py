"""Quality rules: counts of words, symbols and repetition, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed byte 4-grams: one of trusted target documents, one of the whole raw
corpus. A document's score is the mean of log(target / raw) over its grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _common as C
from codeloom.llm import _words as W

BUCKET_BITS = 14
GRAM = 4
SMOOTHING = 1.0
#: Nats per gram below which a document reads unlike the target.
LEAST_RATIO = -0.25
LEAST_WORDS = 10
MOST_REPEATED = 20
REPEAT_WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CHAR_IN_WORD = W.WORD & W.CODE_POINT


def grams(data: np.ndarray, offsets: np.ndarray, bits: int = BUCKET_BITS, size: int = GRAM, most: int = W.BATCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of each run of `size` bytes within one row, at most `most` of them at a time."""
    for a in range(0, len(data) - size + 1, most):
        b = min(a + most, len(data) - size + 1)
        first, last = int(np.searchsorted(offsets, a, side="right")) - 1, int(np.searchsorted(offsets, b - 1, side="right"))
        rows = np.arange(first, last)
        start = np.clip(offsets[rows], a, b)
        end = np.clip(np.maximum(offsets[rows + 1] - size + 1, offsets[rows]), start, b)
        x = np.zeros(b - a, np.uint64)
        for i in range(size):
            x |= data[a + i : b + i].astype(np.uint64) << np.uint64(8 * i)
        bucket = ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        inside = np.zeros(b - a + 1, np.int8)
        # A row without grams opens and closes at one place.
        np.add.at(inside, start - a, 1)
        np.add.at(inside, end - a, -1)
        yield np.repeat(rows, end - start), bucket[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def rule_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = len(offsets) - 1
    start, end, row = W.bounds(data, offsets)
    hashes = W.run_hashes(data, start, end)
    first, window = W.windows(hashes, row, REPEAT_WINDOW)
    again = first[repeated(window ^ W.mix(row[first].astype(np.uint64) + np.uint64(1)))]
    cover = np.zeros(len(row) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, np.minimum(again + REPEAT_WINDOW, len(row)), -1)
    in_repeat = np.cumsum(cover)[: len(row)] > 0
    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    line_row = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.argsort(line_start * 2 + np.concatenate([np.zeros(rows, np.int64), np.ones(len(breaks), np.int64)]), kind="stable")
    line_start, line_row = line_start[order], line_row[order]
    # A line ends at the next break of its row or at the row's end.
    nth = np.searchsorted(breaks, line_start)
    line_end = np.append(breaks, len(data))[nth]
    line_end = np.minimum(line_end, offsets[line_row + 1])
    line_start = np.minimum(line_start, line_end)
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    keys = W.run_hashes(data, line_start, line_end) ^ W.mix(line_row.astype(np.uint64) + np.uint64(1))
    _, kept = np.unique(keys, return_index=True)
    lines = np.bincount(line_row, minlength=rows)
    return {
        "n_words": np.bincount(row, minlength=rows),
        "word_chars": W.per_row(_CHAR_IN_WORD[data], offsets),
        "n_symbols": W.per_row(_SYMBOL[data], offsets),
        "n_dup_lines": lines - np.bincount(line_row[kept], minlength=rows),
        "n_repeat_words": np.bincount(row[in_repeat], minlength=rows),
    }


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled as of good quality, each once."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def gram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, target): counts over all documents and over the trusted ones. Each task sends one row per bucket.
    Ids and texts are both dealt by id at every size: the number of trusted ids grows with the corpus."""
    C.small_batches(docs.sparkSession)
    ids = trusted.select(F.col("doc_id").alias("t_id"), F.lit(True).alias("t")).hint("merge")
    rows = docs.join(ids, docs["doc_id"] == F.col("t_id"), "left").select("text", F.col("t").isNotNull().alias("t"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = (np.zeros(1 << BUCKET_BITS, np.int64) for _ in range(2))
        for batch in C.batches(parts, W.BATCH):
            flag = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, bucket in grams(*C.flat(batch.column(0))):
                raw += np.bincount(bucket, minlength=len(raw))
                target += np.bincount(bucket[flag[row]], minlength=len(raw))
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])

    counts = rows.mapInArrow(count, "bucket int, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratios(counts: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket, smoothed: 2**BUCKET_BITS numbers, whatever the corpus."""
    raw, target = (np.full(1 << BUCKET_BITS, SMOOTHING) for _ in range(2))
    for r in counts.collect():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def judge(docs: DataFrame, labels: DataFrame, least_ratio: float = LEAST_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept.

    Raw counts cover all documents, target counts all trusted ones. A null text has no
    words; a text of fewer than four bytes has ratio 0; without any trusted document the target is flat. Equal texts
    get equal verdicts; repeated rows stay; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(ratios(gram_counts(docs, trusted_ids(labels))))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = table.value
        for batch in C.batches(parts, W.BATCH):
            data, offsets = C.flat(batch.column(1))
            counts = rule_counts(data, offsets)
            total = np.zeros(batch.num_rows)
            for row, bucket in grams(data, offsets):
                total += np.bincount(row, weights=weights[bucket], minlength=batch.num_rows)
            ratio = total / np.maximum(np.diff(offsets) - GRAM + 1, 1)
            failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
            arrays = [batch.column(0), *(pa.array(counts[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(ratio), pa.array(~failed & (ratio >= least_ratio))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, "base_failed", "ratio", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(score, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, ratio double, kept boolean")
