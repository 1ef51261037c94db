"""Incremental table maintenance: numbering, upserts, replacement, pending work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import text as T


def bounded(df: DataFrame, max_rows: int = 20_000, max_bytes: int = 8 << 20) -> DataFrame:
    """A local copy of a table proven to hold at most `max_rows` rows and about `max_bytes`.

    The check reads one row more than the bound. Within both bounds, the result is a local
    relation, made from Arrow, whose exact size the optimizer knows, so joins against it broadcast
    by themselves; beyond them, the table comes back as it was and joins shuffle.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > max_bytes:
        return df
    return df.sparkSession.createDataFrame(rows, df.schema)


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a scan that has fewer splits than the session has cores.

    Input with enough splits, which is any table of some size, passes unchanged.
    For plain scans only: counting the splits of a join would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def number_within(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[str | Column],
    bucket: dict[str, Column],
    name: str = "sequence_index",
) -> DataFrame:
    """0-based running number per partition without one task per partition.

    `bucket` holds columns that are a coarse prefix of the order. Rows are
    numbered inside (partition, bucket) only; each bucket then starts after the
    counts of the buckets before it, so a partition holding a third of the table
    spreads over all its buckets.
    """
    keys = [*partition, *bucket]
    keyed = df.withColumns(bucket)
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*partition).orderBy(*bucket).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy(*keys).orderBy(*order)
    return (
        keyed.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, keys)
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_local", "_before", *bucket)
    )


def id_bucket(column: str, width: int = 65_536) -> dict[str, Column]:
    """Bucket of a unique integer key: at most `width` rows each."""
    return {"_bucket": F.floor(F.col(column) / width)}


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], rules: dict[str, str]
) -> DataFrame:
    """New snapshot of `target` after merging `source` by natural key.

    rules: column -> 'new' (source wins), 'old' (kept once the row exists),
    'coalesce_old' (old unless null), 'coalesce_new' (new unless null).
    A key may appear once in `source`.
    """
    t, s = target.alias("t"), source.alias("s")
    joined = t.withColumn("_old", F.lit(True)).alias("t").join(
        s.withColumn("_new", F.lit(True)).alias("s"), list(keys), "full_outer"
    )
    has_old, has_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def merged(name: str) -> Column:
        old, new = F.col(f"t.{name}"), F.col(f"s.{name}")
        by_rule = {
            "new": F.when(has_new, new).otherwise(old),
            "old": F.when(has_old, old).otherwise(new),
            "coalesce_old": F.coalesce(old, new),
            "coalesce_new": F.coalesce(new, old),
        }
        return by_rule[rules[name]].alias(name)

    rest = [c for c in target.columns if c not in keys]
    return joined.select(*keys, *[merged(c) for c in rest])


#: How each stored entity merges on re-ingest.
AUTHOR_RULES = {"name_ar": "old", "name_en": "new", "death_year": "coalesce_old", "period": "new"}
WORK_RULES = {
    "title_ar": "old", "title_en": "old", "corpus_state": "new", "tradition": "new",
    "method": "new", "classification_source": "new", "catalogue_rank": "new", "is_default": "new",
}
EDITION_RULES = {"work_slug": "old", "publisher": "old", "corpus_state": "new"}


def author_slug(name_en: str | Column) -> Column:
    """Slug of an author: key form with dashes behind a fixed prefix."""
    return F.concat(F.lit("mufassir-"), F.replace(T.key_form(name_en), F.lit(" "), F.lit("-")))


def replace_groups(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace whole groups: rows of `target` whose key occurs in `source` go."""
    kept = target.join(source.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(source)


def write_replacing(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write `df` so that only the partitions it holds are replaced."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def with_classification_source(df: DataFrame, source: str, url: str) -> DataFrame:
    """Classification source and url, null exactly when nothing was classified."""
    unclassified = F.col("tradition") == "UNCLASSIFIED"
    return df.withColumns(
        {
            "classification_source": F.when(~unclassified, F.lit(source)),
            "classification_source_url": F.when(~unclassified, F.lit(url)),
        }
    )


def write_once_ocr(pages: DataFrame, readings: DataFrame) -> DataFrame:
    """Store page readings: raw text only where none is, the rest replaced.

    pages: page_id, ocr_raw_text, ocr_normalized_text, ocr_confidence, needs_review.
    readings: page_id, text, confidence. A blank old reading counts as absent.
    """
    r = readings.select(
        "page_id", F.col("text").alias("_text"), F.col("confidence").alias("_confidence"),
        F.lit(True).alias("_read"),
    )
    old = F.when(~T.is_blank("ocr_raw_text"), F.col("ocr_raw_text"))
    read = F.col("_read").isNotNull()
    return (
        pages.join(r, "page_id", "left")
        .withColumns(
            {
                "ocr_raw_text": F.when(read, F.coalesce(old, "_text")).otherwise(F.col("ocr_raw_text")),
                "ocr_normalized_text": F.when(read, T.matching_form("_text")).otherwise(
                    F.col("ocr_normalized_text")
                ),
                "ocr_confidence": F.when(read, F.col("_confidence")).otherwise(F.col("ocr_confidence")),
                "needs_review": read | F.col("needs_review"),
            }
        )
        .drop("_text", "_confidence", "_read")
    )


def pending_translation(
    published: DataFrame, translations: DataFrame, target: str, limit: int | None = None
) -> DataFrame:
    """Published passages not yet in `target`; with a `limit`, the first of them in work and reading order."""
    done = translations.filter(F.col("language") == target).select("passage_id")
    pending = published.filter(F.col("language") != target).join(done, "passage_id", "left_anti")
    if limit is None:
        return pending
    return pending.orderBy("work_slug", "sequence_index", "passage_id").limit(limit)


def pending_ocr(
    pages: DataFrame, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Pages without a reading, or the pages of an explicit image range."""
    if first is not None:
        return pages.filter(F.col("image_index").between(first, first if last is None else last))
    return pages.filter(F.col("ocr_raw_text").isNull())
