"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import _common as C

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST = 2
SEED = 17
#: Sums that the dynamic programme covers: five bytes each, whatever the budget.
DP_CELLS = 1 << 21
#: Hash ranges that a group of equally long documents is ranked in, so that no group is ranked in one task.
RANGES = 512
#: Most sources whose totals the driver gathers; beyond it the call fails and nothing is dropped.
MOST_SOURCES = 1_000_000


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> dict[str | None, Fraction]:
    """Exact targets: weights repeat over the sources by code point, null last; no target exceeds `most` times its
    source's size, and what is cut off is shared anew by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    left = {s: (weights[i % len(weights)], n) for i, (s, n) in enumerate(order)}
    budget, out = share * sum(n for _, n in order), {}
    while left:
        total = sum(w for w, _ in left.values())
        full = [s for s, (w, n) in left.items() if budget * w > most * n * total]
        if not full:
            return out | {s: Fraction(budget * w) / total for s, (w, _) in left.items()}
        for s in full:
            out[s] = Fraction(most * left.pop(s)[1])
            budget -= out[s]
    return out


def fit(lengths: list[int], counts: list[int], budget: int, cells: int = DP_CELLS) -> list[int]:
    """How many documents of each length to take so that their words come near to the budget.

    A proportional share of every length comes first. A bounded-knapsack programme over reachable sums then fits what
    is left of the budget to the nearest sum, the smaller of two. Its table has `cells` cells whatever the budget: where
    twice the rest needs more, lengths are counted in units, rounded up, and what the rounding leaves is fitted again,
    in smaller units, until a unit is one word.
    """
    total = sum(a * b for a, b in zip(lengths, counts))
    if not total or budget <= 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    took = [c * budget // total for c in counts]
    while (left := budget - sum(a * b for a, b in zip(lengths, took))) > 0:
        unit = -(-2 * left // cells)
        more = nearest(lengths, [c - t for c, t in zip(counts, took)], left, unit)
        took = [a + b for a, b in zip(took, more)]
        if unit == 1 or not any(more):
            break
    return took


def nearest(lengths: list[int], counts: list[int], budget: int, unit: int = 1) -> list[int]:
    """How many of each length have the sum nearest to the budget, lengths and budget counted in units. A sum beyond
    twice the budget is further off than none, so sums up to there are enough. `first` holds the step that first reached
    each sum; going back from a sum, each step is followed by an earlier one."""
    sizes = [-(-n // unit) for n in lengths]
    target = -(-budget // unit)
    most = 2 * target
    order = sorted((i for i, n in enumerate(sizes) if unit <= lengths[i] and n <= most and counts[i]), key=lambda i: -sizes[i])
    mask, reach, steps = (1 << (most + 1)) - 1, 1, []
    first = np.zeros(most + 1, np.int32)
    for i in order:
        n, step = min(counts[i], most // sizes[i]), 1
        while n > 0 and not reach >> target & 1:
            step = min(step, n)
            steps.append((i, step))
            new = (reach << (step * sizes[i])) & mask & ~reach
            if new:
                raw = np.frombuffer(new.to_bytes(most // 8 + 1, "little"), np.uint8)
                at = np.flatnonzero(raw)
                bits = np.unpackbits(raw[at], bitorder="little").reshape(-1, 8)
                row, bit = np.nonzero(bits)
                first[at[row] * 8 + bit] = len(steps)
                reach |= new
            n, step = n - step, 2 * step
    best = (reach & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = reach >> (target + 1)
    if above:
        over = target + (above & -above).bit_length()
        best = over if over - target < target - best else best
    out = [0] * len(lengths)
    while best:
        i, step = steps[first[best] - 1]
        out[i] += step
        best -= step * sizes[i]
    return out


def row_hash(seed: int, id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col(source_col))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document.

    Returns one row per row of docs: doc_id, source, size, source_size, target, copies, taken (= copies * size), hash (of id, text and source). A
    source with target T and size S takes each of its documents floor(T / S) times; the rest of T is fitted on its
    histogram of lengths, and of each length the documents with the smallest seeded hashes are taken once more.
    Null and empty texts have size 0 and are taken once; a null source is a source of its own, ordered last; repeated
    rows are ranked apart; an empty table gives no rows. Equal input gives equal output.

    The driver gathers one total per source (at most MOST_SOURCES). Lengths are fitted per source on counts, whose
    number is bounded by the distinct lengths, and documents are ranked in RANGES hash ranges per source and length.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), row_hash(seed, id_col, text_col, source_col).alias("hash"))
    rows = C.cut(rows.withColumn("part", F.pmod("hash", F.lit(RANGES)).cast("int")), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    kind = rows.schema["source"].dataType.simpleString()
    sizes = {r.source: r.n for r in totals}
    plan, budgets = [], {}
    for s, t in targets(list(sizes.items()), weights, share, most).items():
        n = sizes[s]
        repeats = int(t // n) if n else 1
        budgets[s] = int(round(t)) - repeats * n if n else 0
        plan.append((s, n, float(t), repeats))
    plan = spark.createDataFrame(plan, f"source {kind}, source_size long, target double, repeats long")

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        source = part["source"].iloc[0]
        took = fit(part["size"].tolist(), part["n"].tolist(), budgets[None if pd.isna(source) else source])
        return part.assign(took=took)[["source", "size", "took"]]

    counted = rows.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    lengths = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    chosen = lengths.groupBy("source").applyInPandas(choose, f"source {kind}, size long, took long")
    chosen = chosen.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # Counts per hash range say which ranges are taken whole, which not at all, and which one in part.
    up_to = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    cuts = before.toDF("s", "z", "p", "n", "before").join(chosen, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    cuts = cuts.select("s", "z", "p", "source_size", "target", "repeats", (F.col("took") - F.col("before")).alias("more"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("hash", "doc_id"))
    out = rows.withColumn("rank", rank).join(cuts, same)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("repeats") + (F.col("rank") <= F.col("more")).cast("long")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "hash")


def mixed(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them. Equal rows are taken together: one of them stands for all."""
    out = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col)
    taken = out.groupBy("hash", F.col("doc_id").alias("i")).agg(F.sum("copies").alias("n")).where("n > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_hash(seed, id_col, text_col, source_col).alias("hash"), F.col(id_col).alias("id"))
    # Dealt by the hash alone, so that dropping repeated rows needs no second exchange of the texts.
    met = rows.join(taken, "hash").where(F.col("id").eqNullSafe(F.col("i"))).dropDuplicates(["hash", "id"])
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
