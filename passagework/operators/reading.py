"""Reading view: each verse clause by clause with what every work says there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.operators.clauses import VERSE
from passagework.operators.retrieval import top_by

NOTES_PER_WORK = 3


def reading_notes(
    alignments: DataFrame, published: DataFrame, aligned: DataFrame, works: DataFrame,
    *, work_filter: DataFrame | None = None,
) -> DataFrame:
    """All notes of a verse: published passages whose range starts there.

    Adds clause_index, basis, confidence, opens_discussion, gist where the passage
    is aligned to a clause of that verse. work_filter: column work_slug.
    """
    rows = (
        alignments.select("passage_id", "chapter", F.col("verse_start").alias("verse")).distinct()
        .join(published.select("passage_id", "work_slug", "sequence_index"), "passage_id")
        .join(works.select("work_slug", "catalogue_rank"), "work_slug")
    )
    if work_filter is not None:
        rows = rows.join(work_filter.select("work_slug").distinct(), "work_slug", "left_semi")
    return rows.join(
        aligned.select("passage_id", *VERSE, "clause_index", "basis", "confidence", "opens_discussion", "gist"),
        ["passage_id", *VERSE], "left",
    ).withColumn("basis", F.coalesce("basis", F.lit("UNALIGNED")))


def note_counts(notes: DataFrame) -> DataFrame:
    """Notes available per (verse, clause, work) and whether one opens a discussion; clause -1 holds the unaligned."""
    return (
        notes.withColumn("_clause", F.coalesce("clause_index", F.lit(-1)))
        .groupBy(*VERSE, "_clause", "work_slug")
        .agg(F.count("*").alias("available"), F.bool_or(F.coalesce("opens_discussion", F.lit(False))).alias("_has_opening"))
    )


def capped_notes(notes: DataFrame, per_work: int = NOTES_PER_WORK) -> DataFrame:
    """At most `per_work` notes per (clause, work), openings first.

    A work's notes stand under a clause only if it opens a discussion there;
    unaligned notes are just capped. Adds note_rank and available, the number of
    notes before the cap. Counts are partial aggregates joined to the few rows
    kept, so a popular clause is never gathered whole.
    """
    group = [*VERSE, "_clause", "work_slug"]
    keyed = notes.withColumn("_clause", F.coalesce("clause_index", F.lit(-1)))
    opening = F.coalesce("opens_discussion", F.lit(False))
    facts = note_counts(notes)
    kept = top_by(
        keyed, group,
        [F.when(opening, 0).otherwise(1), "sequence_index", "passage_id"],
        per_work, "note_rank",
    )
    return (
        kept.join(facts, group)
        .filter(F.col("clause_index").isNull() | F.col("_has_opening"))
        .drop("_clause", "_has_opening")
    )


def folded_clauses(clauses: DataFrame, notes: DataFrame) -> DataFrame:
    """Clauses without notes joined to the one before; leading ones to the next.

    Returns chapter, verse, group_index, clause_index, text, support,
    first_clause and last_clause of each group.
    """
    noted = notes.filter("clause_index is not null").select(*VERSE, "clause_index").distinct()
    flagged = clauses.join(noted.withColumn("_noted", F.lit(1)), [*VERSE, "clause_index"], "left")
    running = Window.partitionBy(*VERSE).orderBy("clause_index").rowsBetween(Window.unboundedPreceding, 0)
    grouped = flagged.withColumn(
        "group_index", F.greatest(F.lit(1), F.sum(F.coalesce("_noted", F.lit(0))).over(running)).cast("int")
    )
    texts = F.transform(
        F.array_sort(F.collect_list(F.struct("clause_index", "text"))), lambda x: x["text"]
    )
    return grouped.groupBy(*VERSE, "group_index").agg(
        F.min("clause_index").alias("clause_index"), F.array_join(texts, " ").alias("text"),
        F.max("support").alias("support"),
        F.min("clause_index").alias("first_clause"), F.max("clause_index").alias("last_clause"),
    )


def placed_notes(capped: DataFrame, groups: DataFrame) -> DataFrame:
    """Notes with the group they are shown in; group 0 is further discussion."""
    spans = groups.select(
        *VERSE, "group_index",
        F.explode(F.sequence("first_clause", "last_clause")).alias("clause_index"),
    )
    return capped.join(spans, [*VERSE, "clause_index"], "left").withColumn(
        "group_index", F.coalesce("group_index", F.lit(0))
    )


def reading_references(placed: DataFrame) -> DataFrame:
    """Works numbered by first appearance per verse: clauses first, then the rest."""
    order = F.struct(
        F.when(F.col("group_index") == 0, 1_000_000).otherwise(F.col("group_index")).alias("g"),
        F.col("catalogue_rank").alias("r"), F.col("work_slug").alias("w"),
    )
    first = placed.groupBy(*VERSE, "work_slug").agg(F.min(order).alias("_first"))
    numbered = Window.partitionBy(*VERSE).orderBy("_first")
    return first.withColumn("number", F.row_number().over(numbered)).drop("_first")


def scholars_per_clause(placed: DataFrame) -> DataFrame:
    """Distinct works shown under each clause group."""
    return (
        placed.filter("group_index > 0").groupBy(*VERSE, "group_index")
        .agg(F.countDistinct("work_slug").alias("scholar_count"))
    )


def reading_counts(groups: DataFrame, placed: DataFrame, notes: DataFrame) -> DataFrame:
    """Per verse: clauses, notes_shown, further, notes_available, works."""
    a = groups.groupBy(*VERSE).agg(F.count("*").alias("clauses"))
    b = placed.groupBy(*VERSE).agg(
        F.count("*").alias("notes_shown"), F.count_if(F.col("group_index") == 0).alias("further"),
        F.countDistinct("work_slug").alias("works"),
    )
    c = notes.groupBy(*VERSE).agg(F.count("*").alias("notes_available"))
    return a.join(b, VERSE, "left").join(c, VERSE, "left").na.fill(0)


def build_reading(
    clauses: DataFrame, notes: DataFrame, per_work: int = NOTES_PER_WORK
) -> dict[str, DataFrame]:
    """The whole view: clauses, notes, references, scholars and counts by verse."""
    capped = capped_notes(notes, per_work)
    groups = folded_clauses(clauses, capped)
    placed = placed_notes(capped, groups)
    return {
        "clauses": groups, "notes": placed, "references": reading_references(placed),
        "scholars": scholars_per_clause(placed), "counts": reading_counts(groups, placed, notes),
    }
