"""Governance as data-quality jobs: published view, checks, diffs, integrity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions import vocab as V
from passagework.session import materialise


def published_passages(
    passages: DataFrame, works: DataFrame, editions: DataFrame | None = None
) -> DataFrame:
    """What retrieval may read: neither fixtures nor disputed, work and edition published."""
    live = works.filter(F.col("corpus_state") == "PUBLISHED").select("work_slug")
    out = passages.filter(~F.col("verification_status").isin("FIXTURE", "DISPUTED")).join(
        live, "work_slug", "left_semi"
    )
    if editions is not None:
        open_editions = editions.filter(F.col("corpus_state") == "PUBLISHED").select("edition")
        out = out.join(open_editions, "edition", "left_semi")
    return out


def check(df: DataFrame, table: str, key: str | Column, rules: dict[str, str | Column]) -> DataFrame:
    """Violations (table_name, row_key, rule). As with SQL CHECK, null passes.

    All rules are evaluated in one scan of the table.
    """
    k = (F.col(key) if isinstance(key, str) else key).cast("string")
    broken = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(F.expr(r) if isinstance(r, str) else r, F.lit(True)), F.lit(name))
                for name, r in rules.items()
            ]
        )
    )
    return df.select(
        F.lit(table).alias("table_name"), k.alias("row_key"), F.explode(broken).alias("rule")
    )


def one_of(column: str, allowed: Sequence[str]) -> Column:
    return F.col(column).isin(list(allowed))


#: Row checks per table. A rule is an expression that must not be false.
RULES: dict[str, dict[str, str]] = {
    "scholarly_rule": {
        "rule_scholarly_needs_reference":
            "source_book = 'BASELINE' OR (source_reference IS NOT NULL AND length(trim(source_reference)) > 0)",
        "rule_scholarly_needs_biblio": "source_book = 'BASELINE' OR biblio_source_id IS NOT NULL",
        "rule_verified_needs_reviewer":
            "verification_status <> 'VERIFIED' OR (verified_by IS NOT NULL AND verified_at IS NOT NULL)",
        "rule_tier_matches_provenance":
            "(tier = 'SCHOLARLY_METHOD' AND source_book <> 'BASELINE') "
            "OR (tier <> 'SCHOLARLY_METHOD' AND source_book = 'BASELINE')",
    },
    "work": {
        "classification_needs_source": "tradition = 'UNCLASSIFIED' OR classification_source IS NOT NULL",
    },
    "passage": {
        "passage_page_order": "page_end IS NULL OR page_start IS NULL OR page_end >= page_start",
    },
    "passage_verse": {
        "alignment_range_order": "verse_end >= verse_start",
        "alignment_start_positive": "verse_start > 0",
        "alignment_confidence_range": "confidence BETWEEN 0 AND 1",
    },
    "scan_page": {
        "page_exactly_one_parent": "(edition_id IS NULL) <> (biblio_source_id IS NULL)",
    },
    "verse_summary": {
        "summary_is_synthesis": "evidence_type = 'SYNTHESIS'",
        "summary_has_evidence": "size(cited_passage_ids) > 0",
        "summary_counts_consistent": "sentences_kept + sentences_removed = sentences_generated",
    },
    "author": {"author_years_ordered": "birth_year IS NULL OR death_year IS NULL OR death_year >= birth_year"},
    "author_relation": {"relation_not_self": "from_author <> to_author"},
    "clause": {"clause_word_order": "end_word >= start_word AND start_word >= 0"},
}


def enum_rules(columns: dict[str, Sequence[str]]) -> dict[str, Column]:
    return {f"{name}_domain": one_of(name, allowed) for name, allowed in columns.items()}


def immutability_violations(old: DataFrame, new: DataFrame, key: str, columns: dict[str, bool]) -> DataFrame:
    """Rows whose write-once columns changed between two snapshots.

    columns: name -> True when a blank old value may still be filled in.
    Returns row_key, column.
    """
    a = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns])
    b = new.select(key, *columns)
    changed = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
                    & (~T.is_blank(f"_old_{c}") if fillable else F.lit(True)),
                    F.lit(c),
                )
                for c, fillable in columns.items()
            ]
        )
    )
    return a.join(b, key).select(F.col(key).cast("string").alias("row_key"), F.explode(changed).alias("column"))


def duplicate_keys(df: DataFrame, keys: Sequence[str], where: str | Column | None = None) -> DataFrame:
    """Keys held by more than one row, optionally only among rows meeting `where`."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    known = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(known, child_key, "left_anti")


def cascade_delete(child: DataFrame, deleted: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows left after parents go, where deletion cascades."""
    return child.join(deleted.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def set_null_on_delete(child: DataFrame, deleted: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows with the key emptied where the parent is gone."""
    gone = deleted.select(F.col(parent_key).alias(child_key)).distinct().withColumn("_gone", F.lit(True))
    return child.join(gone, child_key, "left").withColumn(
        child_key, F.when(F.col("_gone").isNull(), F.col(child_key))
    ).drop("_gone").select(*child.columns)


def restricted_deletes(child: DataFrame, deleted: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Parents that may not be deleted because children still name them."""
    return deleted.join(
        child.select(F.col(child_key).alias(parent_key)).distinct(), parent_key, "left_semi"
    )


@dataclass(frozen=True)
class ForeignKey:
    """`child.column` names a row of `parent` by `key`; `rule` says what its deletion does: cascade, set_null or restrict."""

    child: str
    column: str
    parent: str
    key: str
    rule: str


def delete_order(keys: Sequence[ForeignKey], root: str) -> list[str]:
    """Tables reached from `root` by cascades, every parent before its children."""
    reached, open_ = {root}, [root]
    while open_:
        table = open_.pop()
        for k in keys:
            if k.parent == table and k.rule == "cascade" and k.child not in reached:
                reached.add(k.child)
                open_.append(k.child)
    order: list[str] = []
    waiting = set(reached)
    while waiting:
        ready = sorted(t for t in waiting if not any(k.child == t and k.parent in waiting and k.rule == "cascade" for k in keys))
        if not ready:
            raise ValueError(f"cascades run in a circle: {sorted(waiting)}")
        order += ready
        waiting -= set(ready)
    return order


def delete_rows(
    tables: dict[str, DataFrame], ids: dict[str, str], keys: Sequence[ForeignKey], root: str, wanted: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete the rows of `root` whose id is in `wanted`, with what the foreign keys ask for; returns the tables and refused ids.

    ids: the unique id column of each table. Cascades follow over all levels. A row that a restricting child names, anywhere
    below an asked row, refuses that asked row and with it all that only its deletion would take. A child that
    survives has its set_null columns emptied where they name a deleted row. Tables are walked in the order of their
    cascades, one join a foreign key.
    """
    order = delete_order(keys, root)
    # Per table, the rows that go and the asked row each goes with.
    asked = wanted.select(F.col(ids[root]).alias("root")).distinct()
    doomed = {root: materialise(tables[root].select(F.col(ids[root]).alias("id")).join(asked, F.col("id") == F.col("root")))}

    def named(k: ForeignKey) -> DataFrame:
        """(value of the key, root) of the doomed rows of a parent."""
        rows = doomed[k.parent]
        if k.key == ids[k.parent]:
            return rows.select(F.col("id").alias("value"), "root")
        return rows.join(tables[k.parent].select(F.col(ids[k.parent]).alias("id"), F.col(k.key).alias("value")), "id").select("value", "root").distinct()

    for table in order[1:]:
        parts = [
            tables[table].select(F.col(ids[table]).alias("id"), F.col(k.column).alias("value")).join(named(k), "value").select("id", "root")
            for k in keys if k.child == table and k.rule == "cascade" and k.parent in doomed
        ]
        doomed[table] = materialise(reduce(DataFrame.unionByName, parts).distinct())
    refused = [
        named(k).join(tables[k.child].select(F.col(k.column).alias("value")).distinct(), "value", "left_semi").select("root")
        for k in keys if k.rule == "restrict" and k.parent in doomed
    ]
    stopped = materialise(reduce(DataFrame.unionByName, refused).distinct()) if refused else asked.limit(0)
    doomed = {t: d.join(stopped, "root", "left_anti").select("id", "root") for t, d in doomed.items()}
    out = dict(tables)
    for k in keys:
        if k.rule == "set_null" and k.parent in doomed:
            gone = named(k).select(F.col("value").alias(k.column), F.lit(True).alias("_gone")).distinct()
            columns = out[k.child].columns
            emptied = out[k.child].join(gone, k.column, "left").withColumn(k.column, F.when(F.col("_gone").isNull(), F.col(k.column)))
            out[k.child] = emptied.select(*columns)
    for t, d in doomed.items():
        out[t] = out[t].join(d.select(F.col("id").alias(ids[t])).distinct(), ids[t], "left_anti").select(*out[t].columns)
    return out, stopped.select(F.col("root").alias(ids[root]))


def apply_corrections(passages: DataFrame, corrections: DataFrame) -> DataFrame:
    """Latest correction per passage becomes `verified_text`; raw text stays.

    corrections: passage_id, correction_id, corrected_text, corrected_at.
    """
    latest = corrections.groupBy("passage_id").agg(
        F.max_by("corrected_text", F.struct("corrected_at", "correction_id")).alias("_corrected")
    )
    return (
        passages.join(latest, "passage_id", "left")
        .withColumn("verified_text", F.coalesce("_corrected", "verified_text"))
        .drop("_corrected")
    )


def lifecycle_counts(df: DataFrame, column: str = "corpus_state") -> DataFrame:
    """Rows per lifecycle state with the state's place in the order."""
    rank = F.array_position(F.lit(V.CORPUS_STATES), F.col(column)).cast("int")
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("state_rank", rank)
