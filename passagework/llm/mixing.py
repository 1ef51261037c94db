"""Mixing sources to target weights by subset-sum budget fitting.

The documents of a source are counted by exact length. Each is taken whole as often as the source's target holds the
whole source; of what is left, most is dealt to the lengths in proportion to their counts, and the last stretch of the
budget is filled by a bounded-knapsack program over the lengths that still have documents. How many documents of
each length get one copy more is thus known from the counts alone; which ones, a seeded order within the length says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import group_ranks, mapped, prefix_sums
from passagework.session import materialise

#: Words of a source's budget that are left to the knapsack program.
FITTED_WORDS = 1 << 14
#: Bytes that separate words.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def word_totals(column: pa.Array) -> np.ndarray:
    """Number of words of each text of an Arrow string column; null has none."""
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    if not len(wide) or offsets[-1] == offsets[0]:
        return np.zeros(len(wide), dtype=np.int64)
    inside = ~BLANK[np.frombuffer(wide.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    # The first byte of a text starts a word whatever the text before it ends with.
    first = (offsets[:-1] - offsets[0])[offsets[:-1] < offsets[1:]]
    starts[first] = inside[first]
    before = np.concatenate([[0], np.cumsum(starts, dtype=np.int64)])
    return np.diff(before[offsets - offsets[0]])


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, draw): words of each whole text and the document's place in the seeded order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), pa.array(word_totals(b.column("text"))), b.column("draw")], ["doc_id", "source", "size", "draw"]
            )

    drawn = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"))
    kept = [f for f in drawn.schema if f.name == "doc_id"][0].dataType.simpleString()
    return mapped(drawn, count, f"doc_id {kept}, source string, size long, draw long")


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Add `target` to the distinct sources of `totals` (no_source, source, source_size).

    Sources in code-point order, null last, weigh `weights` in turn and share the sum of all sizes. A target stops at
    `most` times its source; the excess is shared again by weight until none is above. So all sources that aren't
    stopped get the same amount per weight, which the sources in order of the amount they stop at give away.
    """
    placed = prefix_sums(totals.withColumn("one", F.lit(1)), ["no_source", "source"], {"index": "one", "all": "source_size"})
    weighed = placed.select(
        *totals.columns, F.col("total_all").alias("all_words"),
        F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("index") % len(weights) + 1).cast("int")).cast("long").alias("weight"),
    ).withColumn("stop", most * F.col("source_size"))
    by_stop = prefix_sums(
        weighed.withColumn("stops_at", F.col("stop") / F.col("weight")), ["stops_at", "no_source", "source"], {"stopped": "stop", "passed": "weight"}
    )
    rest, left = F.col("all_words") - F.col("stopped"), F.col("total_passed") - F.col("passed")
    # The first source that doesn't stop sets the amount; it is given as two integers to keep it exact.
    found = by_stop.where(rest * F.col("weight") <= F.col("stop") * left)
    level = found.groupBy().agg(F.min(F.struct("stops_at", "no_source", "source", rest.alias("rest"), left.alias("left"))).alias("level"))
    share = F.col("level.rest") * F.col("weight") / F.col("level.left")
    return by_stop.crossJoin(level).select(  # one row
        *totals.columns, F.least(F.col("stop").cast("double"), F.coalesce(share, F.lit(0.0))).alias("target")
    )


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, fitted: int = FITTED_WORDS) -> np.ndarray:
    """How many documents of each length make up `budget` words as nearly as can be, each used once at most.

    All but the last `fitted` words (twice the shortest length at least) are dealt from the longest length down, each
    in proportion to its count, what doesn't come out even being passed on to the next. The remaining budget is filled
    by the bounded-knapsack program, to the sum nearest to it, the smaller one of two.
    """
    order = np.argsort(-lengths)
    lengths, counts = lengths[order], counts[order]
    total, taken = int((lengths * counts).sum()), np.zeros(len(lengths), dtype=np.int64)
    real = lengths > 0
    if budget <= 0 or not real.any():
        return taken
    fitted = max(fitted, 2 * int(lengths[real].min()))
    share, carried = max(0, budget - fitted) / total, 0.0
    for i in np.flatnonzero(real).tolist():
        carried += float(lengths[i]) * float(counts[i]) * share
        taken[i] = min(int(counts[i]), int(carried // lengths[i]))
        carried -= float(taken[i]) * float(lengths[i])
    rest = budget - int((taken * lengths).sum())
    taken += knapsack(lengths, counts - taken, max(0, rest))
    return taken[np.argsort(order)]


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Uses of each length, within its count, whose sum comes nearest to `budget` (of two, the smaller one).

    `reached` holds a bit for every sum up to the budget and as far beyond as can be nearer than those below. Each sum remembers the length that first
    reached it and how often it was used to get there, so the way back never uses a length twice over.
    """
    used = np.zeros(len(lengths), dtype=np.int64)
    fits = [i for i in range(len(lengths)) if lengths[i] > 0 and counts[i] > 0]
    if not fits or budget <= 0:
        return used
    width = budget + min(budget, max(int(lengths[i]) for i in fits))  # a sum beyond is no nearer than 0
    mask, reached = (1 << (width + 1)) - 1, 1
    by = np.full(width + 1, -1, dtype=np.int32)
    times = np.zeros(width + 1, dtype=np.int64)
    for i in fits:
        size, fresh = int(lengths[i]), reached
        if size > width:
            continue
        for k in range(1, min(int(counts[i]), width // size) + 1):
            fresh = (fresh << size) & mask & ~reached
            if not fresh:
                break
            at = np.flatnonzero(np.unpackbits(np.frombuffer(fresh.to_bytes(width // 8 + 1, "little"), dtype=np.uint8), bitorder="little"))
            by[at], times[at] = i, k
            reached |= fresh
        if reached >> budget & 1:
            break
    sums = np.flatnonzero(by >= 0)
    sums = np.concatenate([[0], sums])
    best = int(sums[np.lexsort((sums, np.abs(sums - budget)))[0]])
    while best:
        i, k = int(by[best]), int(times[best])
        used[i] += k
        best -= k * int(lengths[i])
    return used


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of `docs` (doc_id, text, source).

    size: the text's words (null or empty: 0); target: words that its source should give; copies: how often the mix
    takes the document, at most `most` times; taken: copies * size. The seeded order and its ties follow from doc_id and
    text alone, so every run gives the same; rows that agree in both are interchangeable. A null source is a source. Documents without
    words are taken as often as their source is taken whole. Empty tables give no rows; further columns are not read.
    """
    keyed = sized(docs, seed).select(
        "doc_id", "source", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("key"), "size", "draw"
    )
    rows = materialise(keyed)
    counts = materialise(rows.groupBy("no_source", "key", "size").agg(F.count("*").alias("n")))
    totals = counts.groupBy("no_source", "key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = materialise(targets(totals.withColumnRenamed("key", "source"), weights, most).withColumnRenamed("source", "key"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        # One row per distinct length of one source: far fewer than its documents.
        whole_size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        whole = min(most, int(target // whole_size)) if whole_size else 0
        budget = int(round(target - whole * whole_size)) if whole < most else 0
        more = fit_counts(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), budget)
        return group.assign(whole=whole, more=more)[["no_source", "key", "size", "source_size", "target", "whole", "more"]]

    fitted = materialise(
        counts.join(aims, ["no_source", "key"]).groupBy("no_source", "key")
        .applyInPandas(fit, "no_source boolean, key string, size long, source_size long, target double, whole int, more long")
    )
    ranked = group_ranks(rows, ["no_source", "key", "size"], ["draw", "doc_id"], fitted)
    copies = F.col("whole") + (F.col("rank") < F.col("more")).cast("int")
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
