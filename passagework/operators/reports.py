"""Corpus reports: catalogue, presets, coverage, source status, inspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import vocab as V
from passagework.operators.understanding import tier_rank


#: Alignments that one task joins to their passages: a large table gets more tasks, not larger ones.
STATS_ROWS = 500_000


def work_stats(works: DataFrame, passages: DataFrame, alignments: DataFrame) -> DataFrame:
    """Works with passage_count and verse_count; works without passages stay.

    A passage counts once per alignment. Counts are taken per work before the
    works join, so the join sees one row per work.
    """
    placed, known = alignments.select("passage_id", "chapter", "verse_start"), passages.select("passage_id", "work_slug")
    tasks = -(-placed.count() // STATS_ROWS)
    if tasks > int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        placed, known = placed.repartition(tasks, "passage_id"), known.repartition(tasks, "passage_id")
    counted = (
        known.join(placed, "passage_id", "left")
        .groupBy("work_slug")
        .agg(
            F.count("passage_id").alias("passage_count"),
            F.countDistinct(F.when(F.col("chapter").isNotNull(), F.struct("chapter", "verse_start"))).alias("verse_count"),
        )
    )
    return works.join(counted, "work_slug", "left").na.fill(0, ["passage_count", "verse_count"])


def catalogue(works: DataFrame, passages: DataFrame, alignments: DataFrame) -> DataFrame:
    """Published works with classification and counts."""
    return work_stats(works.filter(F.col("corpus_state") == "PUBLISHED"), passages, alignments)


def preset_table(spark: SparkSession, presets: Sequence[tuple] = V.PRESETS) -> DataFrame:
    return spark.createDataFrame(
        [(i, *p) for i, p in enumerate(presets)],
        "ord int, preset string, traditions array<string>, methods array<string>, default_only boolean",
    )


def resolve_presets(works: DataFrame, presets: Sequence[tuple] = V.PRESETS) -> DataFrame:
    """preset, work_slugs (by rank, slug), work_count; presets are fixed filters.

    Each work is tested against every preset on its own row, so nothing joins.
    """
    tests = []
    for name, traditions, methods, default_only in presets:
        keep = F.col("corpus_state") == "PUBLISHED"
        if traditions is not None:
            keep = keep & F.col("tradition").isin(list(traditions))
        if methods is not None:
            keep = keep & F.col("method").isin(list(methods))
        if default_only:
            keep = keep & F.col("is_default")
        tests.append(F.when(keep, F.lit(name)))
    chosen = works.select(
        F.explode(F.array_compact(F.array(*tests))).alias("preset"), "catalogue_rank", "work_slug"
    )
    return chosen.groupBy("preset").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("catalogue_rank", "work_slug"))), lambda w: w["work_slug"]
        ).alias("work_slugs"),
        F.count("*").alias("work_count"),
    )


def tradition_histogram(stats: DataFrame) -> DataFrame:
    """Works and passages per tradition, with a total row (tradition null)."""
    return stats.rollup("tradition").agg(
        F.count("*").alias("works"), F.sum("passage_count").alias("passages")
    )


def source_status(pages: DataFrame, by: str = "source_id") -> DataFrame:
    """Per source: pages, readings, verified pages, mean confidence, citable."""
    return (
        pages.groupBy(by)
        .agg(
            F.count("*").alias("pages"), F.count("ocr_raw_text").alias("ocr_complete"),
            F.count("ocr_verified_text").alias("human_verified"),
            F.round(F.avg("ocr_confidence"), 3).alias("mean_ocr_confidence"),
        )
        .withColumn("citable", F.col("human_verified") > 0)
    )


def scan_status(pages: DataFrame) -> DataFrame:
    """Totals over all pages: registered, read, verified, waiting for review."""
    return pages.agg(
        F.count("*").alias("pages"), F.count("ocr_raw_text").alias("ocr_done"),
        F.count("ocr_verified_text").alias("verified"), F.count_if("needs_review").alias("pending_review"),
    )


def translation_coverage(translations: DataFrame, published: DataFrame) -> DataFrame:
    """Per language: n, verified and percent of all published passages."""
    total = published.count()
    percent = F.round(F.col("n") * 100 / total, 3) if total else F.lit(0.0)
    return (
        translations.groupBy("language")
        .agg(F.count("*").alias("n"), F.count_if(F.col("verification_status") == "VERIFIED").alias("verified"))
        .withColumn("percent", percent)
    )


def corpus_health(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n for each table, one small aggregate each."""
    out: DataFrame | None = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def inspect_passages(
    passages: DataFrame, alignments: DataFrame, translations: DataFrame
) -> DataFrame:
    """Every passage with its alignments and translations nested."""
    placed = alignments.groupBy("passage_id").agg(
        F.array_sort(F.collect_list(F.struct("chapter", "verse_start", "verse_end"))).alias("alignments")
    )
    told = translations.groupBy("passage_id").agg(
        F.array_sort(
            F.collect_list(F.struct("language", "translator_name", "translator_kind", "verification_status", "text"))
        ).alias("translations")
    )
    return passages.join(placed, "passage_id", "left").join(told, "passage_id", "left")


def rule_listing(rules: DataFrame, active_only: bool = True) -> DataFrame:
    """Rules in tier order with whether they claim a book."""
    kept = rules.filter("is_active") if active_only else rules
    return kept.select(
        "rule_key", "tier", tier_rank().alias("tier_rank"), "priority", "source_book",
        (F.col("source_book") != "BASELINE").alias("attributed"),
    )


def rule_counts(rules: DataFrame) -> DataFrame:
    """Baseline and attributed rules in force."""
    return rules.filter("is_active").agg(
        F.count_if(F.col("source_book") == "BASELINE").alias("baseline"),
        F.count_if(F.col("source_book") != "BASELINE").alias("attributed"),
    )


def selection(works: DataFrame, kind: str) -> DataFrame:
    """A named selection of the catalogue: sunni, unclassified, commentaries, default."""
    tests: dict[str, Column] = {
        "sunni": F.col("tradition").isin(V.TRADITIONS_SUNNI),
        "unclassified": F.col("tradition") == "UNCLASSIFIED",
        "commentaries": F.col("method").isin(V.COMMENTARY_METHODS),
        "default": F.col("is_default"),
    }
    return works.filter(tests[kind])


def verse_table(verses: DataFrame, chapters: DataFrame) -> DataFrame:
    """Verses with the facts of their chapter."""
    return verses.join(chapters.withColumnRenamed("number", "chapter"), "chapter")


def page_table(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Scanned pages with their source."""
    return pages.join(sources, "source_id", "left")
