"""Pair work inside groups without ever holding or emitting all pairs of a large group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import mapped
from passagework.session import materialise

#: Members of one block; a task compares one block with another at a time.
BLOCK = 512


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive runs of equal `key` (a long) across batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[s] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = keys[s]
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(members: DataFrame, group: list[str], weight: str | None = None, block: int | None = None, block_weight: int = 1 << 20) -> DataFrame:
    """Deal the members of each group into blocks and give each pair of blocks its own key.

    Adds `task` (long, one per pair of blocks), `left` and `right` (whether the row stands on that side; both for a
    block against itself). `id` deals members. A group of one block has one task; a group of m members takes m / block
    tasks per member, so no task ever holds more than about two blocks. Groups of one member are left out.
    """
    block = block or BLOCK
    total = F.sum(weight) if weight else F.lit(0)
    sizes = members.groupBy(*group).agg(F.count("*").alias("_m"), total.alias("_w")).where("_m > 1")
    if weight:
        parts = F.greatest(F.ceil(F.col("_m") / block), F.ceil(F.col("_w") / block_weight))
    else:
        parts = F.ceil(F.col("_m") / block)
    sizes = materialise(sizes.select(*group, parts.cast("int").alias("_n")))
    own = F.pmod(F.xxhash64(F.lit(7), "id"), F.col("_n")).cast("int")
    dealt = members.join(sizes, group).withColumn("_b", own)
    dealt = dealt.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumn("task", F.xxhash64(*group, F.least("_b", "_x"), F.greatest("_b", "_x"))).select(
        *members.columns, "task", (F.col("_b") <= F.col("_x")).alias("left"), (F.col("_b") >= F.col("_x")).alias("right")
    )


def each_task(dealt: DataFrame, columns: list[str], compare: Callable[[pa.Table], Iterator[dict]], schema: str) -> DataFrame:
    """Apply `compare` to the rows of each task; it yields columns of output rows as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "task"):
            for made in compare(group):
                yield pa.RecordBatch.from_pydict(made)

    return dealt.select("task", "left", "right", *columns).repartition("task").sortWithinPartitions("task").transform(mapped, run, schema)


def spanning(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between ids `rows` and `columns` given as a boolean matrix: edges as two lists."""
    ids, place = np.unique(np.concatenate([rows, columns]), return_inverse=True)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a_out, b_out = [], []
    at, to = np.nonzero(linked)
    for a, b in zip(place[: len(rows)][at].tolist(), place[len(rows) :][to].tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            a_out.append(int(ids[a]))
            b_out.append(int(ids[b]))
    return a_out, b_out


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id of `edges` (a, b).

    Each round gives every id the least label among its neighbours and then the label of that label; rounds grow with
    the logarithm of the longest chain. Tables of ids only are written between rounds.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        near = labels.join(seen, "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = materialise(
            near.join(jump, "component", "left").select("id", "was", F.least("component", F.coalesce("further", "component")).alias("component"))
        )
        labels = new.select("id", "component")
        if not new.where("component <> was").take(1):
            return labels


def exact_classes(rows: DataFrame, key: list[str], id: str) -> DataFrame:
    """(key..., rep, copies): the smallest id and the number of rows of each class of equal keys."""
    return rows.groupBy(*key).agg(F.min(id).alias("rep"), F.count("*").alias("copies"))


