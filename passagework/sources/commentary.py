"""Reading commentary trees and turning entries into passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions import vocab as V
from passagework.operators.chunking import chunk_documents
from passagework.operators.tables import number_within
from passagework.session import materialise

ENTRY_SCHEMA = "surah int, ayah int, text string, _corrupt_record string"


def _path(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group).try_cast("int")


def read_commentary_tree(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a tree of `{chapter}/{verse}.json` files.

    Numbers missing from a file come from its path; folders that are not numbers
    and files that are not JSON are skipped. Returns chapter, verse, text, path.
    """
    place = r"/(\d+)/(\d+)\.json$"
    return (
        spark.read.schema(ENTRY_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(path)
        .select("*", F.col("_metadata.file_path").alias("path"), _path(place, 1).alias("_c"), _path(place, 2).alias("_v"))
        .filter(F.col("_corrupt_record").isNull() & F.col("_c").isNotNull())
        .select(
            F.coalesce("surah", "_c").alias("chapter"), F.coalesce("ayah", "_v").alias("verse"), "text", "path"
        )
    )


def read_chapter_files(spark: SparkSession, path: str) -> DataFrame:
    """Entries of `{work}/{chapter}.json` files, each an array of (ayah, text).

    Malformed and empty files give no rows. Returns source_slug, chapter, verse, text.
    """
    return (
        spark.read.schema(ENTRY_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
        .select(
            "ayah", "text", "_corrupt_record",
            F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/\d+\.json$", 1).alias("source_slug"),
            _path(r"/(\d+)\.json$").alias("chapter"),
        )
        .filter(F.col("_corrupt_record").isNull() & F.col("chapter").isNotNull())
        .select("source_slug", "chapter", F.col("ayah").alias("verse"), "text")
    )


CHAPTER_SCHEMA = (
    "number int, name string, englishName string, englishNameTranslation string, "
    "numberOfAyahs int, revelationType string"
)


def derive_chapters(listed: DataFrame, expected: int = 114) -> DataFrame:
    """Chapter table from a chapter list; it must hold exactly `expected` rows.

    The leading word for "chapter" is dropped from names and the plain name is
    the key form.
    """
    found = listed.limit(expected + 1).count()
    if found != expected:
        raise ValueError(f"expected {expected} chapters, found {found}")
    name = F.regexp_replace("name", f"^(?:{'|'.join(V.CHAPTER_NAME_PREFIXES)})", "")
    return listed.select(
        "number", name.alias("name_ar"), T.key_form(name).alias("name_plain"),
        F.col("englishName").alias("translit"), F.col("englishNameTranslation").alias("name_en"),
        F.col("numberOfAyahs").alias("verse_count"),
        F.when(F.col("revelationType") == "Meccan", "MECCAN").otherwise("MEDINAN").alias("revelation_place"),
    )


def read_chapter_list(spark: SparkSession, path: str) -> DataFrame:
    """Chapter list file: an object whose `data` is the array of chapters."""
    wrapped = spark.read.schema(f"data array<struct<{_struct(CHAPTER_SCHEMA)}>>").option("multiLine", True).json(path)
    return wrapped.select(F.explode("data").alias("c")).select("c.*")


def _struct(ddl: str) -> str:
    return ",".join(":".join(f.strip().split(" ", 1)) for f in ddl.split(","))


def register_pages(spark: SparkSession, path: str, source_id: str, volume: int | None = None) -> DataFrame:
    """Page images of a folder as page rows: position, uri and content hash.

    The position is the number in the file name. The images themselves are only
    hashed, in the tasks that read them.
    """
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
        .select(
            F.lit(source_id).alias("source_id"), F.lit(volume).cast("int").alias("volume"),
            F.regexp_extract("path", r"(\d+)\.png$", 1).try_cast("int").alias("image_index"),
            F.col("path").alias("image_uri"), F.sha2("content", 256).alias("sha256"),
        )
        .filter("image_index is not null")
    )


PAGE_RULES = {"image_uri": "new", "sha256": "new"}

OCR_WORD_SCHEMA = (
    "level string, page_num string, block string, paragraph string, line string, word_num string, "
    "left string, top string, width string, height string, conf string, word string"
)


def read_ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Word rows of tab-separated recogniser output, one file per page.

    Short rows and rows whose confidence is not a number are dropped. Returns
    page_id (file name), ord, block, paragraph, line, word, confidence.
    """
    lines = (
        spark.read.option("pathGlobFilter", "*.tsv").text(path, wholetext=True)
        .select(
            F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.tsv$", 1).alias("page_id"),
            F.posexplode(F.split("value", r"\r?\n")).alias("ord", "row"),
        )
        .filter("ord > 0")
        .withColumn("f", F.split("row", "\t"))
        .filter(F.size("f") >= 12)
    )
    field = lambda i: F.get("f", F.lit(i))
    return lines.select(
        "page_id", "ord", field(2).try_cast("int").alias("block"), field(3).try_cast("int").alias("paragraph"),
        field(4).try_cast("int").alias("line"), T.strip(field(11)).alias("word"),
        field(10).try_cast("double").alias("confidence"),
    ).filter("confidence is not null")


def rebuild_pages(words: DataFrame) -> DataFrame:
    """Page text and mean confidence from word rows.

    Blank words and negative confidences are dropped; words join by blanks inside
    a line, lines by newlines in the order they first appear.
    """
    lines = (
        words.filter((F.col("confidence") >= 0) & ~T.is_blank("word"))
        .repartition("page_id")  # words move once; their lines and pages are made where they arrive
        .groupBy("page_id", "block", "paragraph", "line")
        .agg(
            F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "word"))).alias("w"),
            F.sum("confidence").alias("c"), F.count("*").alias("n"),
        )
        .select(
            "page_id", "first", "c", "n", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text")
        )
    )
    return lines.groupBy("page_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), "\n"
        ).alias("text"),
        (F.sum("c") / (F.sum("n") * 100)).alias("confidence"),
    )


# --------------------------------------------------------------------------
# Entries to passages
# --------------------------------------------------------------------------

def check_entries(entries: DataFrame, chapters: DataFrame) -> DataFrame:
    """Entries with stripped text and a `skip` reason (null = kept): blank or place.

    entries: work_slug, chapter, verse, text. chapters: number, verse_count.
    """
    known = chapters.select(F.col("number").alias("chapter"), "verse_count")
    bad_place = F.col("verse_count").isNull() | ~F.col("verse").between(1, F.col("verse_count"))
    return (
        entries.withColumn("text", T.strip(F.coalesce("text", F.lit(""))))
        .join(known, "chapter", "left")
        .withColumn("skip", F.when(F.col("text") == "", "blank").when(bad_place, "place"))
        .drop("verse_count")
    )


def valid_entries(entries: DataFrame, chapters: DataFrame) -> DataFrame:
    return check_entries(entries, chapters).filter("skip is null").drop("skip")


def entry_report(checked: DataFrame) -> DataFrame:
    return checked.groupBy("work_slug").agg(
        F.count_if(F.col("skip").isNull()).alias("kept"),
        F.count_if(F.col("skip") == "blank").alias("skipped_blank"),
        F.count_if(F.col("skip") == "place").alias("skipped_place"),
    )


def ingest(
    entries: DataFrame, chapters: DataFrame, *, target: int = 1200, language: str = "ar",
    ids_per_bucket: int = 65_536,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages, their alignments and one report row per work.

    entries: work_slug, chapter, verse, text, entry_id (unique integer). A passage
    id is a hash of edition and sequence, so reruns agree. In the report a verse
    that has two entries is covered twice; distinct_verses counts it once. A work's numbering is
    split over (chapter, verse, entry bucket) before it is joined up, so one long
    work is no single task.
    """
    checked = check_entries(entries, chapters)
    # Numbering and report read the chunks again, so they are written once.
    chunks = materialise(chunk_documents(checked.filter("skip is null").drop("skip"), "text", target=target))
    numbered = number_within(
        chunks, ["work_slug"], ["chapter", "verse", "entry_id", "chunk_index"],
        {"_c": F.col("chapter"), "_v": F.col("verse"), "_e": F.floor(F.col("entry_id") / ids_per_bucket)},
    )
    passages = numbered.select(
        F.sha2(F.concat_ws("|", "work_slug", F.col("sequence_index").cast("string")), 256).alias("passage_id"),
        "work_slug", "sequence_index", "entry_id", "chapter", "verse", "chunk_index", "raw_text", "matching", "char_count",
        F.lit(language).alias("language"), F.lit("MUFASSIR_INTERPRETATION").alias("evidence_kind"),
        F.lit("UNVERIFIED").alias("verification_status"), F.lit(None).cast("int").alias("volume"),
        F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"),
    )
    alignments = passages.select(
        "passage_id", "chapter", F.col("verse").alias("verse_start"), F.col("verse").alias("verse_end"),
        F.lit("PRIMARY").alias("alignment"), F.lit(0.99).alias("confidence"),
        F.lit("MACHINE_PROPOSED").alias("verification_status"),
    )
    written = chunks.groupBy("work_slug").agg(F.count("*").alias("passages_written"))
    counted = checked.groupBy("work_slug").agg(
        F.count_if(F.col("skip").isNull()).alias("verses_covered"),
        F.countDistinct(F.when(F.col("skip").isNull(), F.struct("chapter", "verse"))).alias("distinct_verses"),
        F.count_if(F.col("skip") == "blank").alias("skipped_empty"),
    )
    report = counted.join(written, "work_slug", "left").na.fill(0, ["passages_written"])
    return passages, alignments, report
