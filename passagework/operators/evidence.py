"""Evidence assembly: citations, works, packages, translations, references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.operators.retrieval import top_by
from passagework.operators.tables import bounded

NO_PAGE = "[no page-level citation available for this edition]"
NOTE_EMPTY = "Insufficient verified evidence was retrieved from the current corpus."
NOTE_NO_PAGE = "No passage in this result set carries a page-level citation."


# --------------------------------------------------------------------------
# Citations
# --------------------------------------------------------------------------

def cite(
    passages: DataFrame,
    works: DataFrame,
    *,
    editions: DataFrame | None = None,
    scan_pages: DataFrame | None = None,
    alignments: DataFrame | None = None,
) -> DataFrame:
    """Complete citation columns on passages, ready to travel with results.

    works: work_slug, title_ar, title_en, author_ar, author_en, death_year.
    editions: edition and its facts (prefixed edition_). scan_pages: scan_page_id,
    scan_page_uri. alignments: passage_id, chapter, verse_start, verse_end, confidence; a passage with several is cited by
    the first of them in the canonical text. Missing authors read as a dash.
    """
    out = passages.join(works, "work_slug").withColumn("author_ar", F.coalesce("author_ar", F.lit("—")))
    if editions is not None:
        out = out.join(editions, "edition")
    if scan_pages is not None:
        out = out.join(scan_pages, "scan_page_id", "left")
    if alignments is not None:
        place = F.struct("chapter", "verse_start", "verse_end", F.col("confidence").alias("alignment_confidence"))
        first = alignments.groupBy("passage_id").agg(F.min(place).alias("_place"))
        out = out.join(first, "passage_id", "left").select("*", "_place.*").drop("_place")
    text = F.coalesce("verified_text", "raw_text") if "verified_text" in passages.columns else F.col("raw_text")
    return out.withColumn("display_text", text)


def resolves_to_page() -> Column:
    return F.col("volume").isNotNull() & F.col("page_start").isNotNull()


def _named(language: Column | str) -> tuple[Column, Column]:
    arabic = (F.lit(language) if isinstance(language, str) else language) == "ar"

    def pick(name: str) -> Column:
        return F.when(arabic, F.col(f"{name}_ar")).otherwise(F.coalesce(f"{name}_en", f"{name}_ar"))

    return pick("author"), pick("title")


def citation_string(language: Column | str = "en", page_end: bool = True) -> Column:
    """`author, title, vol. v, p. a-b`, saying so when it reaches no page."""
    author, title = _named(language)
    page = F.col("page_start").cast("string")
    if page_end:
        page = F.when(
            F.col("page_end").isNotNull() & (F.col("page_end") != F.col("page_start")),
            F.concat(page, F.lit("-"), F.col("page_end").cast("string")),
        ).otherwise(page)
    return F.concat_ws(
        ", ", author, title, F.concat(F.lit("vol. "), F.col("volume").cast("string")),
        F.concat(F.lit("p. "), page), F.when(~resolves_to_page(), F.lit(NO_PAGE)),
    )


def reading_citation(language: Column | str = "en") -> Column:
    """The reading view's variant, which looks at the page alone."""
    author, title = _named(language)
    return F.concat_ws(
        ", ", author, title, F.concat(F.lit("vol. "), F.col("volume").cast("string")),
        F.coalesce(F.concat(F.lit("p. "), F.col("page_start").cast("string")), F.lit(NO_PAGE)),
    )


# --------------------------------------------------------------------------
# Works and packages
# --------------------------------------------------------------------------

def works_of(results: DataFrame, *, chronological: DataFrame | bool = False) -> DataFrame:
    """One row per (query, work) in retrieval or chronological order.

    results: query_id, position, work_slug, death_year, verification_status,
    volume, page_start. chronological: True, or a table (query_id,
    order_by_death_year). Undated works come last, as found.
    """
    grouped = results.groupBy("query_id", "work_slug").agg(
        F.min("position").alias("first_position"), F.count("*").alias("passages_cited"),
        F.first("death_year").alias("death_year"), F.bool_or(resolves_to_page()).alias("resolves_to_page"),
    )
    if isinstance(chronological, bool):
        by_year = F.lit(chronological)
    else:
        grouped = grouped.join(chronological, "query_id", "left")
        by_year = F.coalesce("order_by_death_year", F.lit(False))
    order = Window.partitionBy("query_id").orderBy(
        F.when(by_year, F.col("death_year")).asc_nulls_last(), "first_position"
    )
    out = grouped.withColumn("number", F.row_number().over(order))
    return out.drop("order_by_death_year")


def verification_histogram(results: DataFrame) -> DataFrame:
    """query_id, work_slug, statuses (map of status to count)."""
    counts = results.groupBy("query_id", "work_slug", "verification_status").agg(F.count("*").alias("n"))
    return counts.groupBy("query_id", "work_slug").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("verification_status", "n")))).alias("statuses")
    )


def evidence_packages(
    queries: DataFrame, results: DataFrame, translated: DataFrame | None = None
) -> DataFrame:
    """Measures of each query's result; queries without passages keep a row.

    translated: query_id, passage_id of passages with a stored translation.
    """
    measured = results.groupBy("query_id").agg(
        F.count("*").alias("passage_count"), F.countDistinct("work_slug").alias("work_count"),
        F.count_if(resolves_to_page()).alias("_paged"),
        F.count_if(F.col("verification_status") != "VERIFIED").alias("unverified_count"),
        F.array_sort(F.collect_set("passage_id")).alias("citable_ids"),
    )
    out = queries.select("query_id").join(measured, "query_id", "left")
    if translated is not None:
        done = results.join(translated.select("query_id", "passage_id").distinct(), ["query_id", "passage_id"], "left_semi")
        out = out.join(done.groupBy("query_id").agg(F.count("*").alias("_done")), "query_id", "left")
    else:
        out = out.withColumn("_done", F.lit(0).cast("long"))
    out = out.na.fill(0, ["passage_count", "work_count", "_paged", "unverified_count", "_done"])

    def share(column: str) -> Column:
        return F.when(
            F.col("passage_count") > 0, F.round(F.col(column) / F.col("passage_count"), 6)
        ).otherwise(F.lit(0.0))

    return out.withColumns(
        {
            "is_empty": F.col("passage_count") == 0,
            "page_coverage": share("_paged"),
            "translation_coverage": share("_done"),
        }
    ).drop("_paged", "_done")


def package_notes(pivot_note: Column | None = None) -> Column:
    """Array of statements about the limits of a package."""
    coverage = F.col("page_coverage")
    parts = [
        F.when(F.col("is_empty"), NOTE_EMPTY),
        F.when(~F.col("is_empty") & (coverage == 0), NOTE_NO_PAGE),
        F.when(
            ~F.col("is_empty") & (coverage > 0) & (coverage < 1),
            F.concat(
                F.round(coverage * 100, 0).cast("int").cast("string"),
                F.lit("% of retrieved passages carry a page-level citation."),
            ),
        ),
        F.when(
            F.col("unverified_count") > 0,
            F.concat(
                F.col("unverified_count").cast("string"), F.lit(" of "), F.col("passage_count").cast("string"),
                F.lit(" passages have not been verified against a page image by a human reviewer."),
            ),
        ),
    ]
    if pivot_note is not None:
        parts.append(pivot_note)
    return F.array_compact(F.array(*parts))


def verse_texts(
    query_refs: DataFrame, verses: DataFrame, translations: DataFrame | None = None,
    *, readers: DataFrame | None = None, language: str = "en", pivot: str = "ar",
) -> DataFrame:
    """Canonical verses of each query's ranges with translations for its reader.

    translations: slug, language, chapter, verse, text. readers: query_id,
    language; without it every reader uses `language`. The pivot language needs
    no translation and gets none.
    """
    wanted = (
        query_refs.withColumn("verse", F.explode(F.sequence("verse_start", "verse_end")))
        .select("query_id", "chapter", "verse").distinct()
        .join(verses.select("chapter", "verse", F.col("text").alias("verse_text")), ["chapter", "verse"])
    )
    if translations is None:
        return wanted
    grouped = (
        translations.filter(F.col("language") != pivot).groupBy("chapter", "verse", "language")
        .agg(F.array_sort(F.collect_list(F.struct("slug", "text"))).alias("translations"))
    )
    if readers is None:
        wanted = wanted.withColumn("language", F.lit(language))
    else:
        wanted = wanted.join(readers.select("query_id", "language"), "query_id")
    return wanted.join(grouped, ["chapter", "verse", "language"], "left").withColumn(
        "translations", F.coalesce("translations", F.array().cast("array<struct<slug:string,text:string>>"))
    )


def best_translations(translations: DataFrame) -> DataFrame:
    """One stored translation per (passage, language): human, then verified."""
    return top_by(
        translations, ["passage_id", "language"],
        [
            F.when(F.col("translator_kind") == "HUMAN", 0).otherwise(1),
            F.when(F.col("verification_status") == "VERIFIED", 0).otherwise(1),
            "translator_name", "text",
        ],
        1, "_rn",
    ).drop("_rn")


# --------------------------------------------------------------------------
# Presentation tables and the log
# --------------------------------------------------------------------------

def reference_list(
    results: DataFrame, works: DataFrame, language: Column | str = "en", facts: Sequence[str] = ()
) -> DataFrame:
    """Numbered references: each work once, cited as its first passage is.

    results carry citation columns; works come from `works_of`. `facts` are extra
    columns taken from the first passage, such as edition facts.
    """
    kept = [f for f in facts if f in results.columns]
    first = results.groupBy("query_id", "work_slug").agg(
        F.min_by(
            F.struct(citation_string(language, page_end="page_end" in results.columns).alias("full_citation"), *kept),
            "position",
        ).alias("_f")
    )
    return works.join(first, ["query_id", "work_slug"]).select(
        "query_id", "number", "work_slug", "passages_cited", "resolves_to_page",
        F.col("death_year").isNotNull().alias("dates_known"), "_f.*",
    )


def with_reference_numbers(results: DataFrame, works: DataFrame) -> DataFrame:
    return results.join(
        works.select("query_id", "work_slug", F.col("number").alias("reference_number")), ["query_id", "work_slug"]
    )


def untranslated(
    results: DataFrame, translations: DataFrame, *, wanted: str, pivot: str = "ar"
) -> DataFrame:
    """query_id, passage_id a reader of `wanted` would need translated."""
    if wanted == pivot:
        return results.select("query_id", "passage_id").limit(0)
    done = translations.filter(F.col("language") == wanted).select("passage_id").distinct()
    return (
        results.filter(F.col("language") != wanted).select("query_id", "passage_id")
        .join(done, "passage_id", "left_anti").select("query_id", "passage_id")
    )


def log_rules(runs: DataFrame, applicable: DataFrame, stage: str = "retrieval") -> DataFrame:
    """One row per run and applied rule; re-logging a run adds nothing.

    Repeated runs are one row before the rules join, and rules are distinct for each set of types a run has, so the log
    itself is never sorted or held for duplicates.
    """
    typed = runs.groupBy("run_id").agg(F.array_sort(F.collect_set("classified_type")).alias("_types"))
    known = applicable.select("query_type", "rule_key").distinct()
    sets = typed.select("_types").distinct()
    rules = sets.select("_types", F.explode("_types").alias("query_type")).join(known, "query_type").select("_types", "rule_key").distinct()
    return typed.join(bounded(rules), "_types").select("run_id", "rule_key", F.lit(stage).alias("stage"))


def untranslated_for_readers(results: DataFrame, translations: DataFrame, readers: DataFrame) -> DataFrame:
    """query_id, passage_id of results that a query's reader (query_id, language) can't read yet."""
    wanted = readers.select("query_id", F.col("language").alias("_wanted"))
    done = translations.select("passage_id", F.col("language").alias("_wanted")).distinct()
    foreign = results.select("query_id", "passage_id", "language").join(wanted, "query_id").filter(F.col("language") != F.col("_wanted"))
    return foreign.join(done, ["passage_id", "_wanted"], "left_anti").select("query_id", "passage_id")


def run_rows(understood: DataFrame, packages: DataFrame) -> DataFrame:
    """One audit row per query: what was asked, how it was understood and how much evidence came back."""
    refs = F.transform(
        "refs",
        lambda r: F.concat(
            r["chapter"].cast("string"), F.lit(":"), r["verse_start"].cast("string"),
            F.when(r["verse_end"] > r["verse_start"], F.concat(F.lit("-"), r["verse_end"].cast("string"))).otherwise(""),
        ),
    )
    return understood.join(packages.select("query_id", F.col("passage_count").alias("evidence_count")), "query_id", "left").select(
        F.col("query_id").alias("run_id"), F.col("text").alias("raw_query"), F.col("reader_language").alias("user_language"),
        F.col("pivot_text").alias("pivot_query"), F.col("language").alias("detected_language"),
        F.col("query_type").alias("classified_type"), F.col("confidence").alias("classification_confidence"),
        F.to_json(refs).alias("resolved_refs"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
    )


def append_log(df: DataFrame, path: str, keys: Sequence[str], date: str = "run_date") -> None:
    """Append rows whose key is not in the log yet; the log lies in folders of `date`, a column of `df`.

    Only the folders of the batch's own dates are read. One writer at a time owns a date: the check and the
    append are two steps, so two writers of one date could both append.
    """
    spark = df.sparkSession
    dates = [r[0] for r in df.select(date).distinct().collect()]  # the days of one batch
    try:
        known = spark.read.schema(df.schema).parquet(path).filter(F.col(date).isin(dates)).select(*keys, date)
    except Exception as missing:  # the first append creates the log
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        known = None
    fresh = df if known is None else df.join(known, [*keys, date], "left_anti")
    fresh.write.mode("append").partitionBy(date).parquet(path)
