"""Helpers that several of these operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.session import materialise

#: Text that one step of a Python task holds in expanded form, in bytes.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one Arrow batch between the JVM and a Python task: at Spark's default of 10,000 whole documents, both
#: sides would hold tens of megabytes per batch, and keep them.
BATCH_ROWS = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """`df.mapInArrow` with batches of a bounded number of documents; lowers the session's setting where it is higher."""
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    return df.mapInArrow(function, schema)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose `column` has about `limit` bytes (one row at least).

    Arrow batches are bounded by rows, not by bytes; a slice bounds what a task
    expands into Python objects at once. A single longer text is one slice.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def prefix_sums(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add to `rows` the global running sum *before* each row, for each column of `sums`.

    Adds `{name}` for each (name, column), `total_{name}` with the sum over all rows,
    and leaves the rows in no order. Rows are dealt into ranges of `order`, each range
    is summed, the few range totals are summed up in order, and each row adds what its
    own range holds before it. No task sees more than one range. `order` must be unique.
    """
    dealt = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    base = totals.select(
        "part",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"base_{n}") for n in sums],
        *[F.sum(n).over(whole).alias(f"total_{n}") for n in sums],
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"in_{n}") for n, c in sums.items()])
    # One row a range: as many as the exchange has partitions, so its size is bounded by a setting.
    return (
        local.join(F.broadcast(base), "part")
        .select(
            *rows.columns,
            *[(F.col(f"base_{n}") + F.col(f"in_{n}")).alias(n) for n in sums],
            *[f"total_{n}" for n in sums],
        )
    )


def group_ranks(rows: DataFrame, group: list[str], order: list[str], groups: DataFrame) -> DataFrame:
    """Join `groups`, one row for each value of `group` (none null), to `rows`, and add `rank`: the row's number from 0 within its group.

    Rows are dealt into ranges, so that a group of any size spreads over as many tasks as it has ranges; each range counts
    its rows of each group, and only those counts are added up per group. Rows that agree in `order` are numbered in any order.
    """
    keys = [*group, *order]
    spread = f"_spread_{uuid.uuid4().hex}"  # equal rows too may fall into several ranges
    dealt = materialise(
        rows.withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(*keys, spread).withColumn("part", F.spark_partition_id())
    )
    pieces = dealt.groupBy("part", *group).agg(F.count("*").alias("held"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held").join(groups, group)
    inside = F.row_number().over(Window.partitionBy("part", *group).orderBy(*order, spread))
    numbered = dealt.withColumn("inside", inside)
    return (
        numbered.join(placed, ["part", *group])
        .withColumn("rank", F.col("before") + F.col("inside") - 1).drop("part", "inside", "before", spread)
    )
