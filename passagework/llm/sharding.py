"""Contiguous shards of nearly equal bytes from global prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import prefix_sums
from passagework.session import materialise

#: Bytes that each document takes besides its text.
ROW_BYTES = 8


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Deal every document into one of `shards` contiguous runs of doc_id, equal in bytes.

    Returns doc_id, size, text_crc32, shard, slot, byte_start. A document belongs to the
    shard in whose share of all bytes its middle byte lies, so a shard's size differs from
    the equal target by at most the largest document. `slot` numbers a shard's documents from 0.

    Null text has no bytes and crc32 0; null doc_ids come first; repeated ids and repeated rows
    are rows of their own in a fixed order; an empty table gives an empty result; more columns of
    the input, whatever their names, are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    # Texts are read once; what follows moves a few numbers per document.
    narrow = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),
            F.lit(1).cast("long").alias("one"),
        )
    )
    summed = prefix_sums(narrow, ["doc_id", "row"], {"byte_start": "size", "index": "one"})
    placed = materialise(
        summed.select(
            "doc_id", "size", "text_crc32", "byte_start", "index",
            F.least(F.lit(shards - 1), F.expr(f"(({shards} * (byte_start * 2 + size)) div (2 * total_byte_start))")).cast("int").alias("shard"),
        )
    )
    first = placed.groupBy("shard").agg(F.min("index").alias("first"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot"), "byte_start"
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write documents as shard=N folders, in slot order within each file; doc_id must be unique."""
    spots = placed.select("doc_id", "shard", "slot", "byte_start")
    own = [c for c in docs.columns if c not in ("shard", "slot", "byte_start")]
    joined = docs.select(*own).join(spots, "doc_id")
    joined.repartitionByRange("byte_start").sortWithinPartitions("shard", "slot").drop("byte_start").write.partitionBy(
        "shard"
    ).parquet(path)
