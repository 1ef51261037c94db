"""Resumable ingest: new commentary files become passages with ids, alignments and counts, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagework.operators.chunking import chunk_documents
from passagework.operators.tables import number_within, write_replacing
from passagework.session import materialise
from passagework.sources.commentary import ENTRY_SCHEMA, check_entries

#: Folder columns of every table: a file owns exactly one folder, whatever else has its work and chapter.
FILE = ["work_slug", "chapter", "file"]


def ingest_stream(
    spark: SparkSession,
    source: str,
    chapters: DataFrame,
    target: str,
    checkpoint: str,
    *,
    files_per_batch: int = 1_000,
    language: str = "ar",
) -> StreamingQuery:
    """Ingest `{work}/{chapter}.json` files that were not ingested before, then stop.

    Writes `{target}/passages`, `{target}/alignments` and `{target}/counts`. The checkpoint
    remembers the files seen, empty ones included, so a rerun costs nothing for them. Each
    batch replaces exactly the folders of its files, and clears them where no passage is left,
    so a batch repeated after a failure leaves the same tables.
    """
    place = r"/([^/]+)/(\d+)\.json$"
    path = F.col("_metadata.file_path")
    entries = (
        spark.readStream.schema(ENTRY_SCHEMA).option("multiLine", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", files_per_batch).json(source)
        .select(
            "ayah", "text", "_corrupt_record",
            F.regexp_extract(path, place, 1).alias("work_slug"),
            F.regexp_extract(path, place, 2).try_cast("int").alias("chapter"),
            F.md5(path).alias("file"),
        )
    )

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.filter("chapter is not null").select(
            *FILE, F.col("ayah").alias("verse"), "text", F.col("_corrupt_record").isNotNull().alias("corrupt")
        )
        checked = materialise(check_entries(rows, chapters).withColumn("skip", F.when(F.col("corrupt"), "corrupt").otherwise(F.col("skip"))))
        chunks = materialise(chunk_documents(checked.filter("skip is null").drop("skip", "corrupt"), "text"))
        passages = chunks.withColumns(
            {
                "passage_id": F.sha2(F.concat_ws("|", *FILE, "verse", "chunk_index"), 256),
                "language": F.lit(language), "evidence_kind": F.lit("MUFASSIR_INTERPRETATION"),
                "verification_status": F.lit("UNVERIFIED"),
            }
        )
        alignments = passages.select(
            *FILE, "passage_id", F.col("verse").alias("verse_start"), F.col("verse").alias("verse_end"),
            F.lit("PRIMARY").alias("alignment"), F.lit(0.99).alias("confidence"),
            F.lit("MACHINE_PROPOSED").alias("verification_status"),
        )
        counts = checked.groupBy(*FILE).agg(
            F.count_if(F.col("skip").isNull()).alias("kept"),
            *[F.count_if(F.col("skip") == s).alias(f"skipped_{s}") for s in ("blank", "place", "corrupt")],
        )
        # One row per file of the batch, so bounded by files_per_batch.
        for emptied in counts.filter("kept = 0").select(*FILE).collect():
            for name in ("passages", "alignments"):
                _clear(spark, "/".join([f"{target}/{name}", *[f"{c}={emptied[c]}" for c in FILE]]))
        for name, table in (("passages", passages), ("alignments", alignments), ("counts", counts)):
            write_replacing(table, f"{target}/{name}", FILE)

    return (
        entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _clear(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ingested_passages(spark: SparkSession, target: str) -> DataFrame:
    """All passages ingested so far, numbered within their work."""
    return number_within(
        spark.read.parquet(f"{target}/passages"), ["work_slug"], ["chapter", "verse", "file", "chunk_index"],
        {"_c": F.col("chapter"), "_v": F.col("verse")},
    )


def ingest_report(spark: SparkSession, target: str) -> DataFrame:
    """Per work: files, entries kept and skipped, passages written."""
    counts = spark.read.parquet(f"{target}/counts").groupBy("work_slug").agg(
        F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("kept", "skipped_blank", "skipped_place", "skipped_corrupt")]
    )
    written = spark.read.parquet(f"{target}/passages").groupBy("work_slug").agg(F.count("*").alias("passages_written"))
    return counts.join(written, "work_slug", "left").na.fill(0, ["passages_written"])
