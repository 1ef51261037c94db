"""Lexical grounding of generated sentences in the passages they were written from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions import vocab as V
from passagework.operators.clauses import VERSE
from passagework.operators.retrieval import top_by

MAX_PASSAGES, MIN_PASSAGES = 10, 3
MIN_SUPPORT, MAX_SUPPORT, MAX_ECHO, NEAR_BEST = 0.20, 0.92, 0.6, 0.75
MIN_SENTENCE_CHARS, COPY_WORDS = 15, 6


def pick_evidence(notes: DataFrame, max_passages: int = MAX_PASSAGES) -> DataFrame:
    """chapter, verse, marker, passage_id, work_slug: one passage per work.

    Openings come first, then reading order; works are numbered alphabetically.
    """
    opening = F.coalesce("opens_discussion", F.lit(False))
    one = top_by(
        notes, [*VERSE, "work_slug"],
        [F.when(opening, 0).otherwise(1), "sequence_index", "passage_id"], 1, "_one",
    )
    return top_by(one, VERSE, ["work_slug"], max_passages, "marker").select(
        *VERSE, "marker", "passage_id", "work_slug"
    )


def split_generated(
    texts: DataFrame, text: str = "text", *, min_chars: int = MIN_SENTENCE_CHARS
) -> DataFrame:
    """Sentences of each output: all other columns, ord, sentence, declared markers."""
    kept = [c for c in texts.columns if c != text]
    inner = f"[{V.WHITESPACE}&&[^\\n]]+"
    cleaned = T.strip(F.regexp_replace(text, inner, " "))
    raw = F.split(cleaned, rf"\n+|(?<=[.؟!۔])[{V.WHITESPACE}]+")
    long = F.filter(F.transform(raw, T.strip), lambda s: F.length(s) >= min_chars)
    marker = r"\[(\d{1,2})\]"
    return (
        T.unnest(texts, kept, long, "_s", "ord")
        .select(
            *kept, "ord", T.strip(F.regexp_replace("_s", marker, "")).alias("sentence"),
            F.regexp_extract_all("_s", F.lit(marker), F.lit(1)).cast("array<int>").alias("declared"),
        )
    )


def support_scores(
    sentences: DataFrame, evidence: DataFrame, key: Sequence[str], *, stop_words: Sequence[str] = V.SUPPORT_STOP_WORDS
) -> DataFrame:
    """key, ord, marker, shared: content words of a sentence held by a passage.

    sentences: key, ord, chapter, verse, words (array). evidence: chapter, verse,
    marker, text. Words meet by an equi-join inside the verse, and a verse has at
    most ten passages, so one word matches at most ten rows.
    """
    stems = T.content_words(T.matching_form("text"), stop_words=stop_words)
    held = T.unnest(evidence, [*VERSE, "marker"], stems, "word")
    asked = T.unnest(sentences, [*key, "ord", *VERSE], "words", "word")
    return asked.join(held, [*VERSE, "word"]).groupBy(*key, "ord", "marker").agg(F.count("*").alias("shared"))


def verify_sentences(
    sentences: DataFrame,
    evidence: DataFrame,
    verses: DataFrame,
    key: Sequence[str],
    *,
    foreign: str | None = "[A-Za-z]{2,}",
    stop_words: Sequence[str] = V.SUPPORT_STOP_WORDS,
) -> DataFrame:
    """Verdict on every sentence against the passages of its verse.

    sentences: key, chapter, verse, ord, sentence, declared. Adds support, echo,
    citations (markers), kept, reason. `foreign` is a pattern that marks text from
    another script as corrupt, or None.
    """
    prepared = sentences.withColumn(
        "words", T.content_words(T.matching_form("sentence"), stop_words=stop_words)
    )
    verse_words = verses.select(
        *VERSE, T.content_words(T.matching_form("text"), stop_words=stop_words).alias("_verse_words")
    )
    scores = support_scores(prepared, evidence, key, stop_words=stop_words)
    per_sentence = scores.groupBy(*key, "ord").agg(
        F.collect_list(F.struct("marker", "shared")).alias("_scores")
    )
    n = F.size("words")
    shares = F.transform(
        F.coalesce("_scores", F.array().cast("array<struct<marker:int,shared:bigint>>")),
        lambda s: F.struct(s["marker"].alias("marker"), (s["shared"] / n).alias("share")),
    )
    rows = (
        prepared.join(per_sentence, [*key, "ord"], "left")
        .join(verse_words, VERSE, "left")
        .withColumn("_shares", shares)
        .withColumns(
            {
                "support": F.when(
                    F.size("_shares") > 0, F.array_max(F.transform("_shares", lambda s: s["share"]))
                ).otherwise(F.lit(0.0)),
                "echo": F.when(
                    n > 0, F.size(F.array_intersect("words", F.coalesce("_verse_words", F.array().cast("array<string>")))) / n
                ).otherwise(F.lit(0.0)),
            }
        )
    )
    strong = F.filter("_shares", lambda s: s["share"] >= MIN_SUPPORT)
    near = F.filter(strong, lambda s: s["share"] >= F.col("support") * NEAR_BEST)
    named = F.filter(strong, lambda s: F.array_contains("declared", s["marker"]))
    valid = F.array_sort(F.array_distinct(F.transform(F.concat(near, named), lambda s: s["marker"])))
    corrupt = F.col("sentence").rlike(foreign) if foreign else F.lit(False)
    echoes = F.col("echo") > MAX_ECHO
    copied = (F.col("support") > MAX_SUPPORT) & (n > COPY_WORDS)
    reason = (
        F.when(corrupt, "foreign script inside the text")
        .when(echoes, "restates the verse")
        .when(copied, "reproduces the passage")
        .when(F.size("_valid") == 0, "no passage supports this sentence")
    )
    dropped_early = corrupt | echoes
    return (
        rows.withColumn("_valid", valid)
        .withColumn("reason", reason)
        .withColumns(
            {
                "kept": F.col("reason").isNull(),
                "citations": F.when(dropped_early, F.array().cast("array<int>")).otherwise(F.col("_valid")),
                "support": F.when(dropped_early, F.lit(0.0)).otherwise(F.round("support", 3)),
                "echo": F.round("echo", 3),
            }
        )
        .select(*key, *VERSE, "ord", "sentence", "support", "echo", "citations", "kept", "reason")
    )


def selection_key(works: Column | str) -> Column:
    """Stable key of a source selection: sorted slugs, or `*` for all."""
    w = F.col(works) if isinstance(works, str) else works
    return F.when(w.isNull() | (F.size(w) == 0), "*").otherwise(F.array_join(F.array_sort(w), ","))


def summarise_verdicts(
    verdicts: DataFrame, evidence: DataFrame, key: Sequence[str], *, min_passages: int = MIN_PASSAGES
) -> DataFrame:
    """One row per output: counts, mean support of kept sentences, cited ids, text.

    Outputs of a verse with fewer than `min_passages` passages carry a note and
    nothing else.
    """
    markers = F.array_join(F.transform("citations", lambda m: F.concat(F.lit("["), m.cast("string"), F.lit("]"))), "")
    line = F.when(F.col("kept"), F.struct("ord", F.concat("sentence", F.lit(" "), markers).alias("line")))
    counts = verdicts.groupBy(*key, *VERSE).agg(
        F.count("*").alias("sentences_generated"), F.count_if("kept").alias("sentences_kept"),
        F.count_if(~F.col("kept")).alias("sentences_removed"),
        F.round(F.avg(F.when(F.col("kept"), F.col("support"))), 3).alias("mean_support"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), " "
        ).alias("summary_text"),
    )
    cited = (
        verdicts.filter("kept").select(*key, *VERSE, F.explode("citations").alias("marker"))
        .distinct()
        .join(evidence.select(*VERSE, "marker", "passage_id"), [*VERSE, "marker"])
        .groupBy(*key)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("marker", "passage_id"))), lambda x: x["passage_id"]
            ).alias("cited_passage_ids")
        )
    )
    available = evidence.groupBy(*VERSE).agg(F.count("*").alias("n_passages"))
    few = F.coalesce("n_passages", F.lit(0)) < min_passages
    return (
        counts.join(cited, list(key), "left").join(available, VERSE, "left")
        .withColumn("note", F.when(few, "too few passages").when(F.col("sentences_kept") == 0, "no traceable sentence"))
        .withColumns(
            {
                "summary_text": F.when(few, "").otherwise(F.col("summary_text")),
                "verification_status": F.lit("MACHINE_PROPOSED"),
            }
        )
    )


def fabricated_citations(cited: DataFrame, citable: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cited ids outside the citable set of their package."""
    return cited.join(citable.select(*key, "passage_id").distinct(), [*key, "passage_id"], "left_anti")
