"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives and unlabelled web text train a small network; the class prior is estimated from how the scores of
a first model spread over both. Features are counts of the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm import _common as C
from codeloom.llm import _words as W
from codeloom.llm.quality_rules import grams, repeated, rule_counts

#: Rows that the model is fitted on, at most, unless a call names other bounds.
POSITIVE_ROWS = 6_000
UNLABELLED_ROWS = 12_000
GRAM_BITS = 8
HIDDEN = 24
EPOCHS = 40
BATCH = 512
RATE = 0.003
DECAY = 1e-4
SEED = 11
#: Score of a text on the model's decision boundary.
BOUNDARY = 0.7

_UPPER, _LOWER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_MARK[[x for x in range(33, 127) if not chr(x).isalnum()]] = True


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never looked at."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text, all zero for a text without bytes."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    counts = rule_counts(data, offsets)
    start, end, row = W.bounds(data, offsets)
    hashes = W.run_hashes(data, start, end)
    words = np.maximum(counts["n_words"], 1)
    equal = np.flatnonzero((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])) if len(row) > 1 else np.zeros(0, np.int64)
    twice = repeated(hashes ^ W.mix(row.astype(np.uint64) + np.uint64(1)))
    long = np.maximum(size, 1)
    dense = [
        np.log1p(counts["n_words"]) / 8,
        counts["word_chars"] / words / 10,
        counts["n_symbols"] / words,
        W.per_row(_UPPER[data], offsets) / np.maximum(W.per_row(_UPPER[data] | _LOWER[data], offsets), 1),
        W.per_row(_DIGIT[data], offsets) / long,
        W.per_row(_MARK[data], offsets) / words,
        counts["n_dup_lines"] / np.maximum(1, W.per_row(data == 10, offsets) + 1),
        counts["n_repeat_words"] / words,
        np.bincount(row[equal], minlength=rows) / words,
        np.bincount(row[twice], minlength=rows) / words,
    ]
    hashed = np.zeros(rows << GRAM_BITS, np.int64)
    for r, b in grams(data, offsets, GRAM_BITS, 3):
        hashed += np.bincount((r << GRAM_BITS) + b, minlength=len(hashed))
    hashed = hashed.reshape(rows, -1)
    hashed = np.sqrt(hashed / np.maximum(hashed.sum(axis=1, keepdims=True), 1))
    return np.concatenate([np.stack(dense, axis=1), hashed], axis=1).astype(np.float32)


def feature_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and x, the features of each text as float32 bytes."""
    C.small_batches(docs.sparkSession)
    docs = docs.select(*keep, "text")

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(parts, W.BATCH):
            x = features(*C.flat(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([r.tobytes() for r in x], pa.binary())], [*keep, "x"])

    return docs.mapInArrow(make, T.StructType([*docs.schema.fields[: len(keep)], T.StructField("x", T.BinaryType())]))


class Network:
    """One hidden layer over standardised features."""

    def __init__(self, width: int, seed: int):
        rng = np.random.default_rng(seed)
        self.w1 = (rng.standard_normal((width, HIDDEN)) / np.sqrt(width)).astype(np.float32)
        self.b1, self.b2 = np.zeros(HIDDEN, np.float32), np.zeros(1, np.float32)
        self.w2 = (rng.standard_normal((HIDDEN, 1)) / np.sqrt(HIDDEN)).astype(np.float32)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)

    def standardise(self, x: np.ndarray) -> None:
        self.mean = x.mean(axis=0)
        self.scale = 1 / (x.std(axis=0) + 1e-3)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) * self.scale, -8, 8)
        h = np.maximum(z @ self.w1 + self.b1, 0)
        return z, h, (h @ self.w2 + self.b2)[:, 0]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[2]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = SEED, epochs: int = EPOCHS) -> Network:
    """Minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with the sigmoid loss; where the
    second term is negative, its gradient is followed upwards instead. prior None: plain logistic loss of positive
    against unlabelled."""
    net = Network(positive.shape[1], seed)
    net.standardise(unlabelled)
    rng = np.random.default_rng(seed + 1)
    params = ["w1", "b1", "w2", "b2"]
    m, v = ({p: np.zeros_like(getattr(net, p)) for p in params} for _ in range(2))
    t = 0
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        steps = max(1, len(unlabelled) // BATCH)
        for p_at, u_at in zip(np.array_split(np.resize(p_order, max(len(p_order), steps)), steps), np.array_split(u_order, steps)):
            p, u = positive[p_at], unlabelled[u_at]
            z, h, f = net.forward(np.concatenate([p, u]))
            n, s = len(p), _sigmoid(f)
            g = np.empty(len(f), np.float32)
            if prior is None:
                g[:n], g[n:] = (s[:n] - 1) / n, s[n:] / len(u)
            else:
                slope = s * (1 - s)
                negative = s[n:].mean() - prior * s[:n].mean()
                if negative >= 0:
                    g[:n], g[n:] = -2 * prior * slope[:n] / n, slope[n:] / len(u)
                else:
                    g[:n], g[n:] = prior * slope[:n] / n, -slope[n:] / len(u)
            dh = (g[:, None] @ net.w2.T) * (h > 0)
            grads = {"w1": z.T @ dh + DECAY * net.w1, "b1": dh.sum(axis=0), "w2": h.T @ g[:, None] + DECAY * net.w2, "b2": np.array([g.sum()], np.float32)}
            t += 1
            for k in params:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                step = RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, (getattr(net, k) - step).astype(np.float32))
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Largest share of positives that the scores of unlabelled rows allow: the smallest ratio of both upper tails,
    over cuts that keep at least two fifths of the positives."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.6, 30))
    return float(np.clip(min((unlabelled >= c).mean() / (positive >= c).mean() for c in cuts), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = SEED) -> tuple[Network, float]:
    """The network and the estimated prior. Models of one half of the rows are read on the other half: first plain
    ones, then twice models of the risk under the prior found so far."""
    prior = None
    for _ in range(3):
        found = []
        for i in (0, 1):
            net = train(positive[i::2], unlabelled[i::2], prior, seed)
            found.append(class_prior(net.margin(positive[1 - i :: 2]), net.margin(unlabelled[1 - i :: 2])))
        prior = min(np.mean(found), prior or 1.0)
    return train(positive, unlabelled, prior, seed), prior


def sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVE_ROWS, unlabelled: int = UNLABELLED_ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, positive): the rows to fit on, none of them held out."""
    order = [F.xxhash64(F.lit(seed), "doc_id"), "doc_id"]
    free = ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()
    good = labels.where(free & (F.col("quality") == 1)).select("doc_id").distinct().orderBy(*order).limit(positives)
    rest = docs.where(free).select("doc_id").distinct().orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").limit(unlabelled)
    return good.withColumn("positive", F.lit(True)).unionByName(rest.withColumn("positive", F.lit(False)))


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVE_ROWS, unlabelled: int = UNLABELLED_ROWS) -> Network | None:
    """The model of a table of doc_id and text; None without positives or without other rows to fit on. Of rows that
    share a chosen id one is fitted on, so that the driver gets no more rows than ids were chosen."""
    chosen = F.broadcast(sample(docs, labels, positives, unlabelled).withColumnRenamed("doc_id", "s_id"))
    rows = feature_rows(docs.join(chosen, docs["doc_id"] == F.col("s_id")).select("s_id", "positive", "text"), "s_id", "positive")
    got = rows.groupBy("s_id", "positive").agg(F.min("x").alias("x")).select("positive", "x").collect()
    x = [np.array([np.frombuffer(r.x, np.float32) for r in got if r.positive == kind]) for kind in (True, False)]
    for part in x:
        if len(part):
            part[:] = part[np.lexsort(part.T[:12])]
            np.random.default_rng(SEED).shuffle(part)
    return fit(*x)[0] if all(map(len, x)) else None


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVE_ROWS, unlabelled: int = UNLABELLED_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    A null text counts as empty and is scored; a null id is not held out and never fitted on; repeated rows stay; an
    empty table gives no rows; without positives or other rows to fit on every score is 0.5. The model is fitted on at
    most `positives` trusted rows and `unlabelled` others, those with the smallest seeded hashes, whose features are all
    that the driver holds; every row is scored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, positives, unlabelled))
    shift = float(np.log(BOUNDARY / (1 - BOUNDARY)))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in C.batches(parts, W.BATCH):
            f = features(*C.flat(batch.column(1)))
            s = _sigmoid(net.margin(f).astype(np.float64) + shift) if net is not None else np.full(len(f), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= BOUNDARY).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", positives: int = POSITIVE_ROWS, unlabelled: int = UNLABELLED_ROWS) -> DataFrame:
    """The rows of docs, all columns, that the classifier predicts to be of good quality; without a model, all rows."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.select("doc_id", F.col(text_col).alias("text")), labels, positives, unlabelled))
    shift = float(np.log(BOUNDARY / (1 - BOUNDARY)))

    def good(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in C.batches(parts, W.BATCH):
            if net is None:
                yield batch
                continue
            f = features(*C.flat(batch.column(batch.schema.get_field_index(text_col))))
            yield batch.filter(pa.array(_sigmoid(net.margin(f).astype(np.float64) + shift) >= BOUNDARY))

    return docs.mapInArrow(good, docs.schema)
