"""Clauses of the canonical text, derived from what passages quote.

A passage meets its verse by one join; quotations, spans and overlaps are then
array expressions on that row. Only counting support shuffles again, and it does
so on the full span key with partial counts, so a popular verse is no hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions import vocab as V
from passagework.session import materialise

MIN_QUOTE_WORDS = 2
MIN_SUPPORT = 3
QUOTED_CONFIDENCE, OVERLAP_CONFIDENCE = 0.9, 0.55

VERSE = ["chapter", "verse"]


def verse_words(verses: DataFrame, text: str = "text") -> DataFrame:
    """chapter, verse, words (matching form) and display words of each verse."""
    shown = T.collapse_whitespace(T.strip_waqf_marks(text))
    return verses.select(
        *VERSE, T.words(T.matching_form(text)).alias("words"), T.words(shown).alias("display_words")
    )


def quotations(c: Column | str, brackets: Sequence[str] = T.BRACKETS) -> Column:
    """Bracketed quotations of a composed text in order, in matching form."""
    pattern = F.lit("|".join(brackets))
    parts = [F.regexp_extract_all(c, pattern, F.lit(i)) for i in range(1, len(brackets) + 1)]
    raw = parts[0]
    for extra in parts[1:]:
        raw = F.zip_with(raw, extra, lambda a, b: F.when(a != "", a).otherwise(b))
    return F.filter(F.transform(raw, T.fold_composed), lambda q: q != "")


def extract_quotations(
    passages: DataFrame, text: str = "raw_text", brackets: Sequence[str] = T.BRACKETS
) -> DataFrame:
    """passage_id, ord, quotation."""
    composed = passages.select("passage_id", T.compose(text).alias("_t"))
    return T.unnest(composed, ["passage_id"], quotations("_t", brackets), "quotation", "ord")


def _span(quoted: Column, words: Column) -> Column:
    """Longest run of the verse that begins with the quotation's first word.

    struct(length, first): `first` is negated so that array_max prefers the
    earliest of equally long runs. Null when the first word does not occur.
    """
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda s: F.get(words, s) == F.get(quoted, F.lit(0)),
    )

    def run(s: Column) -> Column:
        room = F.least(F.size(quoted), F.size(words) - s)
        same = F.zip_with(F.slice(words, s + 1, room), F.slice(quoted, F.lit(1), room), lambda a, b: a == b)
        miss = F.array_position(same, F.lit(False)).cast("int")
        return F.struct(F.when(miss == 0, room).otherwise(miss - 1).alias("length"), (-s).alias("first"))

    return F.array_max(F.transform(starts, run))


def quoted_spans(
    passage_verses: DataFrame, verses: DataFrame, *, text: str = "raw_text",
    brackets: Sequence[str] = T.BRACKETS, min_words: int = MIN_QUOTE_WORDS, carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per (passage, verse): its words and the spans it quotes, in order.

    passage_verses: passage_id, chapter, verse, text. verses: output of
    `verse_words`. Adds `spans`, array of (ord, start_word, end_word), and the columns of `carry`,
    which are taken from the same read of the text.
    """
    carry = carry or {}
    quotes = F.filter(
        F.transform(quotations("_t", brackets), lambda q: F.split(q, " ")),
        lambda w: F.size(w) >= min_words,
    )
    rows = (
        passage_verses.select("passage_id", *VERSE, T.compose(text).alias("_t"), *[c.alias(n) for n, c in carry.items()])
        .select("passage_id", *VERSE, quotes.alias("_quotes"), "_t", *carry)
        .join(verses.select(*VERSE, "words"), VERSE)
    )
    found = F.transform(
        "_quotes",
        lambda q, i: F.struct(i.alias("ord"), _span(q, F.col("words")).alias("run")),
    )
    spans = F.transform(
        F.filter(found, lambda f: f["run"].isNotNull()),
        lambda f: F.struct(
            f["ord"].alias("ord"), (-f["run"]["first"]).alias("start_word"),
            (f["run"]["length"] - f["run"]["first"] - 1).alias("end_word"),
        ),
    )
    return rows.select(
        "passage_id", *VERSE, *carry, "words",
        F.array_distinct(F.split(T.fold_composed("_t"), " ")).alias("passage_words"),
        F.when(F.size("_quotes") > 0, spans)
        .otherwise(F.array().cast("array<struct<ord:int,start_word:int,end_word:int>>")).alias("spans"),
    )


def span_support(spans: DataFrame) -> DataFrame:
    """chapter, verse, start_word, end_word, support: passages quoting each span."""
    return (
        T.unnest(spans, ["passage_id", *VERSE], "spans", "s")
        .select("passage_id", *VERSE, "s.start_word", "s.end_word")
        .groupBy(*VERSE, "start_word", "end_word")
        .agg(F.countDistinct("passage_id").alias("support"))
    )


_SPAN = "array<struct<start_word:int,end_word:int,support:bigint>>"


def accept_spans(support: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Non-overlapping spans per verse, best supported first, shorter before longer.

    Returns chapter, verse, accepted (array, by start). A verse of n words has at
    most n(n+1)/2 spans, so the ordered list stays small however many passages.
    """
    ranked = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col("support")).alias("rank"), (F.col("end_word") - F.col("start_word")).alias("span_length"),
                "start_word", "end_word", "support",
            )
        )
    )

    def step(acc: Column, s: Column) -> Column:
        clash = F.exists(
            acc, lambda a: (s["start_word"] <= a["end_word"]) & (a["start_word"] <= s["end_word"])
        )
        kept = F.struct(
            s["start_word"].alias("start_word"), s["end_word"].alias("end_word"), s["support"].alias("support")
        )
        return F.when(clash, acc).otherwise(F.array_append(acc, kept))

    return (
        support.filter(F.col("support") >= min_support)
        .groupBy(*VERSE)
        .agg(ranked.alias("_ranked"))
        .select(*VERSE, F.array_sort(F.aggregate("_ranked", F.array().cast(_SPAN), step)).alias("accepted"))
    )


def cover_verses(verses: DataFrame, accepted: DataFrame) -> DataFrame:
    """Clause rows covering every word of each verse exactly once.

    A clause reaches to the word before the next accepted span; the first starts
    at word 0. Verses without accepted spans are one clause of support 0.
    """
    n = F.size("words")
    whole = F.array(F.struct(F.lit(0).alias("start_word"), F.lit(0).alias("end_word"), F.lit(0).cast("long").alias("support")))
    spans = F.coalesce(F.col("accepted"), whole.cast(_SPAN))
    rows = (
        verses.join(accepted, VERSE, "left")
        .filter(n > 0)
        .withColumn("_spans", spans)
        .select(*VERSE, "words", "display_words", "_spans", F.posexplode("_spans").alias("clause_index", "_s"))
    )
    following = F.get(F.col("_spans.start_word"), F.col("clause_index") + 1)
    start = F.when(F.col("clause_index") == 0, 0).otherwise(F.col("_s.start_word"))
    end = F.coalesce(following, n) - 1
    size = F.col("end_word") - F.col("start_word") + 1
    return (
        rows.withColumns({"start_word": start, "end_word": end})
        .select(
            *VERSE, "clause_index", "start_word", "end_word",
            F.array_join(F.slice("display_words", F.col("start_word") + 1, size), " ").alias("text"),
            F.array_join(F.slice("words", F.col("start_word") + 1, size), " ").alias("normalized"),
            F.col("_s.support").alias("support"),
        )
    )


def _best_run(
    words: Column, held: Column, function_words: Sequence[str], content_length: int
) -> Column:
    """Best island of consecutive verse words the passage holds.

    Content words decide and length breaks ties; within an island the score only
    grows, so running totals suffice. The fold carries the held words, so they are
    worked out once per passage. struct(first, last, best): best is the length.
    """
    empty = (
        "struct<held:array<string>,start:int,length:int,content:int,pos:int,score:int,first:int,last:int,best:int>"
    )
    start = F.struct(held.alias("held"), *[F.lit(0).alias(f"_{i}") for i in range(8)]).cast(empty)

    def step(acc: Column, w: Column) -> Column:
        hit = F.array_contains(acc["held"], w) & (F.length(w) > 1)
        content = (F.length(w) >= content_length) & ~F.array_contains(T.word_list(function_words), w)
        length = acc["length"] + 1
        total = F.when(acc["length"] == 0, 0).otherwise(acc["content"]) + content.cast("int")
        first = F.when(acc["length"] == 0, acc["pos"]).otherwise(acc["start"])
        score = total * 100 + length
        better = (total > 0) & (score > acc["score"])
        grown = [
            first, length, total, acc["pos"] + 1, F.when(better, score).otherwise(acc["score"]),
            F.when(better, first).otherwise(acc["first"]), F.when(better, acc["pos"]).otherwise(acc["last"]),
            F.when(better, length).otherwise(acc["best"]),
        ]
        broken = [F.lit(0), F.lit(0), F.lit(0), acc["pos"] + 1, acc["score"], acc["first"], acc["last"], acc["best"]]

        def packed(parts: list[Column]) -> Column:
            return F.struct(acc["held"].alias("held"), *[p.alias(f"_{i}") for i, p in enumerate(parts)]).cast(empty)

        return F.when(hit, packed(grown)).otherwise(packed(broken))

    return F.aggregate(
        words, start, step,
        lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"), acc["best"].alias("best")),
    )


def align_passages(
    spans: DataFrame,
    clauses: DataFrame,
    *,
    function_words: Sequence[str] = V.CLAUSE_FUNCTION_WORDS,
    content_length: int = 4,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Which clause each passage treats, by quotation or else by word overlap.

    Returns passage_id, chapter, verse, clause_index, basis, matched_words,
    confidence and the columns of `carry`; passages with no evidence are left out.
    """
    per_verse = clauses.groupBy(*VERSE).agg(
        F.array_sort(F.collect_list(F.struct("clause_index", "start_word", "end_word"))).alias("clauses")
    )
    longest = F.array_max(
        F.transform(
            "spans",
            lambda s: F.struct(
                (s["end_word"] - s["start_word"] + 1).alias("length"), (-s["ord"]).alias("earliest"),
                s["start_word"].alias("first"), s["end_word"].alias("last"),
            ),
        )
    )
    run = _best_run(F.col("words"), F.array_intersect("words", "passage_words"), function_words, content_length)
    evidence = F.when(
        F.col("_quote").isNotNull(),
        F.struct(F.lit("QUOTED").alias("basis"), F.col("_quote.first").alias("first"), F.col("_quote.last").alias("last")),
    ).when(
        F.col("_run.best") >= 2,
        F.struct(F.lit("OVERLAP").alias("basis"), F.col("_run.first").alias("first"), F.col("_run.last").alias("last")),
    )
    best = F.array_max(
        F.transform(
            "clauses",
            lambda c: F.struct(
                (F.least("_e.last", c["end_word"]) - F.greatest("_e.first", c["start_word"]) + 1).alias("matched"),
                (-c["clause_index"]).alias("index"), (c["end_word"] - c["start_word"] + 1).alias("size"),
            ),
        )
    )
    base = F.when(F.col("_e.basis") == "QUOTED", QUOTED_CONFIDENCE).otherwise(OVERLAP_CONFIDENCE)
    # Rows without evidence go by unnesting an empty array: a filter would be
    # pushed below and repeat the whole search.
    searched = (
        spans.join(per_verse, VERSE)
        .withColumn("_quote", longest)
        .withColumn("_run", F.when(F.col("_quote").isNull(), run))
    )
    held = T.unnest(searched, ["passage_id", *VERSE, *carry, "clauses"], F.array(evidence), "_e")
    return (
        T.unnest(held, ["passage_id", *VERSE, *carry, "_e"], F.filter(F.array(best), lambda b: b["matched"] > 0), "_best")
        .select(
            "passage_id", *VERSE, (-F.col("_best.index")).alias("clause_index"), F.col("_e.basis").alias("basis"),
            F.col("_best.matched").alias("matched_words"),
            F.round(base * F.least(F.lit(1.0), F.col("_best.matched") / F.col("_best.size")), 3).alias("confidence"), *carry,
        )
    )


def passages_by_verse(alignments: DataFrame, passages: DataFrame, text: str = "raw_text") -> DataFrame:
    """passage_id, chapter, verse, text: passages whose range starts at the verse."""
    return (
        alignments.select("passage_id", "chapter", F.col("verse_start").alias("verse")).distinct()
        .join(passages.select("passage_id", text), "passage_id")
    )


def build_clauses(
    passage_verses: DataFrame, verses: DataFrame, *, text: str = "raw_text",
    brackets: Sequence[str] = T.BRACKETS, headers: Sequence[str] = V.CLAUSE_HEADERS,
) -> tuple[DataFrame, DataFrame]:
    """Clauses of every verse that has commentary, and the passages' alignments.

    The alignments carry gist and opens_discussion, ready for the reading view. Texts are read once: the
    spans, with both columns, are written. So are the clauses, whose measured size then lets them
    broadcast, and word lists meet them where they lie.
    """
    covered = passage_verses.select(*VERSE).distinct()
    words = verse_words(verses).join(covered, VERSE, "left_semi")
    carry = {
        "gist": T.gist(text, headers=headers),
        "opens_discussion": T.opens_discussion(text, headers=headers, brackets=brackets),
    }
    spans = materialise(quoted_spans(passage_verses, words, text=text, brackets=brackets, carry=carry))
    clauses = materialise(cover_verses(words, accept_spans(span_support(spans))))
    return clauses, align_passages(spans, clauses, carry=list(carry))


def clause_report(clauses: DataFrame, passage_verses: DataFrame, aligned: DataFrame) -> DataFrame:
    """Per verse: clauses, passages, aligned passages and the share aligned."""
    a = clauses.groupBy(*VERSE).agg(F.count("*").alias("clauses"))
    b = passage_verses.groupBy(*VERSE).agg(F.count("*").alias("passages"))
    c = aligned.groupBy(*VERSE).agg(F.count("*").alias("aligned"))
    return (
        a.join(b, VERSE).join(c, VERSE, "left").na.fill(0, ["aligned"])
        .withColumn("aligned_share", F.round(F.col("aligned") / F.col("passages"), 3))
    )


def mine_quotations(
    documents: DataFrame, items: DataFrame, *, size: int = 5, min_run: int | None = None
) -> DataFrame:
    """Maximal verbatim runs of canonical items inside unbracketed documents.

    documents: doc_id, text. items: item_id, text. Word n-grams meet by equality;
    hits on one diagonal (same offset between document and item) that follow each
    other are one run. A diagonal of one document and item is no longer than the
    item, so no group grows with the corpus.
    """
    least = size if min_run is None else min_run

    def shingles(df: DataFrame, key: str, position: str) -> DataFrame:
        grams = F.when(
            F.size("_w") >= size,
            F.transform(
                F.sequence(F.lit(0), F.size("_w") - size),
                lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(F.col("_w"), i + 1, F.lit(size)), " ").alias("gram")),
            ),
        )
        return (
            T.unnest(df.select(key, T.words(T.matching_form("text")).alias("_w")), [key], grams, "g")
            .select(key, F.col("g.pos").alias(position), F.col("g.gram").alias("gram"))
        )

    hits = shingles(documents, "doc_id", "doc_pos").join(shingles(items, "item_id", "item_pos"), "gram")
    along = Window.partitionBy("doc_id", "item_id", "diagonal").orderBy("item_pos")
    return (
        hits.withColumn("diagonal", F.col("doc_pos") - F.col("item_pos"))
        .withColumn("_island", F.col("item_pos") - F.row_number().over(along))
        .groupBy("doc_id", "item_id", "diagonal", "_island")
        .agg(F.min("doc_pos").alias("doc_start"), F.min("item_pos").alias("item_start"),
             (F.count("*").cast("int") + size - 1).alias("words"))
        .filter(F.col("words") >= least)
        .select("doc_id", "item_id", "doc_start", "item_start", "words")
    )
