"""Registered queries of the sources: driver tables written as the files that the readers know, then read back.

Files are written by the tasks that hold their rows, into the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.plans import sql_text as S
from passagework.plans.driver_views import with_views
from passagework.plans.registry import query
from passagework.session import shared_folder
from passagework.sources import commentary as X
from passagework.streaming import ingest as I


def write_files(rows: DataFrame, folder: str) -> str:
    """Write the `content` of each row to its own `path` under `folder`; a repeated task writes the same files again."""
    root = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                system, name = fs.FileSystem.from_uri(f"{root}/{path}")
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(name) as out:
                    out.write(content.encode())
            yield pd.DataFrame({"n": [len(b)]})

    rows.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return folder


def write_arrays(entries: DataFrame, folder: str) -> str:
    """Write the `entry` texts of each `path` as one JSON array under `folder`, ordered by `ayah` and `text`.

    Entries stream to the task of their file, which writes them one by one, so no file is ever held whole.
    """
    root = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = object(), None
        for b in batches:
            for path, entry in zip(b["path"], b["entry"], strict=True):
                if path == now:
                    out.write(b",")
                else:
                    if out is not None:
                        out.write(b"]")
                        out.close()
                    system, name = fs.FileSystem.from_uri(f"{root}/{path}")
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    now, out = path, system.open_output_stream(name)
                    out.write(b"[")
                out.write(entry.encode())
            yield pd.DataFrame({"n": [len(b)]})
        if out is not None:
            out.write(b"]")
            out.close()

    dealt = entries.select("path", "ayah", "text", "entry").repartition("path").sortWithinPartitions("path", "ayah", "text")
    dealt.select("path", "entry").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return folder


def folder(c, name: str) -> str:
    return f"{shared_folder(c.spark)}/{name}-{uuid.uuid4().hex}"


def text(*parts) -> object:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(
    "a1_read_tree",
    with_views("""SELECT chapter, verse, md5(text) AS text_hash FROM v_verse WHERE item_id % 11 <> 3 AND item_id % 13 <> 5"""),
)
def a1(c):
    """One file a verse: some broken, some in folders that are no number, some without their numbers inside."""
    i = F.col("item_id")
    inside = F.when(i % 7 == 2, F.to_json(F.struct("text"))).otherwise(F.to_json(F.struct(F.col("chapter").alias("surah"), F.col("verse").alias("ayah"), "text")))
    place = F.when(i % 13 == 5, text("notes/", F.col("verse"))).otherwise(text(F.col("chapter"), "/", F.col("verse")))
    files = c.verses.select(F.concat(place, F.lit(".json")).alias("path"), F.when(i % 11 == 3, "{broken").otherwise(inside).alias("content"))
    read = X.read_commentary_tree(c.spark, write_files(files, folder(c, "tree")))
    return read.select(F.col("chapter").cast("long").alias("chapter"), F.col("verse").cast("long").alias("verse"), F.md5("text").alias("text_hash"))


def write_chapters(c, folder: str) -> str:
    """`{work}/{chapter}.json`: the documents of a work by chapter, as an array of entries; the files of one work are broken."""
    d = F.col("doc_id")
    ayah = F.floor(d / 5).cast("int").alias("ayah")
    entries = c.table("documents").select(
        text(F.col("source"), "/", d % 5 + 1, ".json").alias("path"), ayah, "text", F.to_json(F.struct(ayah, "text")).alias("entry"),
        F.coalesce(F.col("source") == "src7", F.lit(False)).alias("broken"),
    )
    write_files(entries.filter("broken").select("path").distinct().withColumn("content", F.lit("[{")), folder)
    return write_arrays(entries.filter("not broken"), folder)


@query(
    "a2_read_chapter_files",
    "SELECT source AS source_slug, doc_id % 5 + 1 AS chapter, doc_id // 5 AS verse, md5(text) AS text_hash FROM documents WHERE source <> 'src7'",
)
def a2(c):
    read = X.read_chapter_files(c.spark, write_chapters(c, folder(c, "chapters")))
    return read.select("source_slug", F.col("chapter").cast("long").alias("chapter"), F.col("verse").cast("long").alias("verse"), F.md5("text").alias("text_hash"))


@query(
    "a9_chapter_list",
    f"""SELECT CAST(s_suppkey AS BIGINT) AS number, s_name AS name_ar, {S.key('s_name')} AS name_plain, 'No. ' || s_nationkey AS translit, 'The ' || s_name AS name_en,
      CAST(s_nationkey + 3 AS BIGINT) AS verse_count, CASE WHEN s_acctbal > 0 THEN 'MECCAN' ELSE 'MEDINAN' END AS revelation_place FROM supplier""",
)
def a9(c):
    """A chapter list with one chapter for every supplier, their names behind the word for chapter in every second one."""
    k = F.col("s_suppkey")
    prefix = F.when(k % 2 == 0, F.lit(T.V.CHAPTER_NAME_PREFIXES[0])).otherwise("")
    listed = c.table("supplier").select(
        F.struct(
            k.cast("int").alias("number"), F.concat(prefix, "s_name").alias("name"), text("No. ", F.col("s_nationkey")).alias("englishName"),
            text("The ", F.col("s_name")).alias("englishNameTranslation"), (F.col("s_nationkey") + 3).cast("int").alias("numberOfAyahs"),
            F.when(F.col("s_acctbal") > 0, "Meccan").otherwise("Medinan").alias("revelationType"),
        ).alias("c")
    )
    file = listed.agg(F.to_json(F.struct(F.collect_list("c").alias("data"))).alias("content")).withColumn("path", F.lit("list.json"))
    chapters = X.derive_chapters(X.read_chapter_list(c.spark, write_files(file, folder(c, "list"))), c.table("supplier").count())
    return chapters.withColumns({n: F.col(n).cast("long") for n in ("number", "verse_count")})


@query(
    "a10_register_pages",
    "SELECT 'scan' AS source_id, 3 AS volume, CAST(page_id AS INT) AS image_index, 'page-' || page_id || '.png' AS file, sha256(html) AS sha256 FROM pages",
)
def a10(c):
    """Page images (here: the pages' bytes) by number and hash; a file without a number is none."""
    p = c.table("pages")
    files = p.select(text("page-", F.col("page_id"), ".png").alias("path"), F.col("html").alias("content")).unionByName(
        p.select(text("cover", ".png").alias("path"), F.lit("cover").alias("content")).limit(1)
    )
    read = X.register_pages(c.spark, write_files(files, folder(c, "scans")), "scan", 3)
    return read.select("source_id", "volume", "image_index", F.regexp_extract("image_uri", "[^/]+$", 0).alias("file"), "sha256")


@query(
    "a14_ingest_stream",
    with_views(f"""SELECT source AS work_slug, count(DISTINCT doc_id % 5) AS files, count(*) FILTER (WHERE source <> 'src7' AND {S.strip('text')} <> '' AND doc_id // 5 BETWEEN 1 AND 8) AS kept,
      count(*) FILTER (WHERE source <> 'src7' AND {S.strip('text')} = '') AS skipped_blank,
      count(*) FILTER (WHERE source <> 'src7' AND {S.strip('text')} <> '' AND doc_id // 5 NOT BETWEEN 1 AND 8) AS skipped_place,
      CASE WHEN source = 'src7' THEN count(DISTINCT doc_id % 5) ELSE 0 END AS skipped_corrupt FROM documents GROUP BY source"""),
)
def a14(c):
    """Two runs of the stream over the same files: the second finds nothing new."""
    source, target = write_chapters(c, folder(c, "stream")), folder(c, "ingested")
    chapters = c.spark.range(1, 6).select(F.col("id").cast("int").alias("number"), F.lit(8).alias("verse_count"))
    for _ in range(2):
        I.ingest_stream(c.spark, source, chapters, target, f"{target}/seen", files_per_batch=40).awaitTermination()
    return I.ingest_report(c.spark, target).drop("passages_written")
