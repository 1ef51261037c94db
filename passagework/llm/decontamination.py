"""Benchmark passages found through a positional inverted index (DataFrame functions only).

Postings (term, document, position) of the training text are stored once. An item is looked up by the two
rarest terms of each of its windows: their lists, moved by the terms' offsets, meet in the alignments at which
the item may stand in a document. Only those alignments are compared term by term. Runs of agreeing terms are
exact phrases; windows in which most terms agree are proximity matches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of digits, small ASCII letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Term of the one posting per document that stands before its first word and holds its doc_id and number of words.
START = ""


def words(text: str = "text"):
    """Words of a text in order; null has none."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def row_key(docs: DataFrame):
    """Identifies a row by its doc_id and text; rows that agree in both agree in every result."""
    return F.xxhash64(F.lit(1), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, n, at, term): the words of each distinct item row, their positions and number; `item` identifies the row."""
    listed = items.select(
        F.xxhash64(F.lit(2), F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))).alias("item"),
        "item_id", words().alias("words"),
    ).where(F.size("words") > 0).distinct()
    return listed.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))


def build_postings(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Stored postings (term, key, pos) of every document; of the terms in `vocabulary` (term), where it is given.

    Each document also has the posting START at -1 with its doc_id and n_words, so its text is read once only.
    """
    named = docs.select(row_key(docs).alias("key"), "doc_id", F.concat(F.array(F.lit(START)), words()).alias("words"))
    # The outer form: the plain one makes the optimizer take the words twice.
    found = named.select("key", "doc_id", (F.size("words") - 1).cast("long").alias("n_words"), F.posexplode_outer("words").alias("at", "term"))
    if vocabulary is not None:
        started = docs.sparkSession.range(1).select(F.lit(START).alias("term"))
        found = found.join(vocabulary.select("term").union(started), "term", "left_semi")
    first = F.col("at") == 0
    return materialise(
        found.select("term", "key", (F.col("at") - 1).alias("pos"), F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("n_words")).alias("n_words"))
    )


def posted_terms(postings: DataFrame) -> DataFrame:
    """(term, key, pos) of the words of stored postings."""
    return postings.where(F.col("pos") >= 0).select("term", "key", "pos")


def posted_documents(postings: DataFrame) -> DataFrame:
    """(doc_id, key, n_words) of every document row of stored postings."""
    return postings.where(F.col("pos") < 0).select("doc_id", "key", "n_words")


def alignments(postings: DataFrame, terms: DataFrame, window: int, missing: int = 0) -> DataFrame:
    """Distinct (item, key, shift) at which an item may stand in a document.

    With nothing missing the two rarest terms of some window must both be in place. Where `missing` terms may be out of
    place, one of the missing + 1 rarest must still be in place, so each of those is followed alone.
    """
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    # One window starts at each position that has enough words left; a short item is one window.
    known = terms.join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - (window - 1)), F.least("at", F.greatest(F.lit(0), F.col("n") - window)))
    inside = known.select("item", "at", "term", "df", F.explode(starts).alias("start"))
    rank = F.row_number().over(Window.partitionBy("item", "start").orderBy("df", "at"))
    rarest = inside.withColumn("rank", rank).where(F.col("rank") <= max(2, missing + 1))
    if missing:
        each = materialise(rarest.select("item", "term", "at").distinct())
        return postings.join(each, "term").select("item", "key", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    second = rarest.where("rank = 2").select("item", "start", F.col("term").alias("term2"), F.col("at").alias("at2"))
    both = materialise(
        rarest.where("rank = 1").select("item", "start", "term", "at").join(second, ["item", "start"], "left")
        .select("item", "term", "at", "term2", "at2").distinct()
    )
    place = ["item", "at", "at2", "key", "shift"]
    one = postings.join(both, "term").select("item", "at", "at2", "key", (F.col("pos") - F.col("at")).alias("shift"))
    two = (
        postings.withColumnRenamed("term", "term2").join(both.where("at2 is not null"), "term2")
        .select("item", "at", "at2", "key", (F.col("pos") - F.col("at2")).alias("shift"))
    )
    met = one.where("at2 is not null").join(two, place, "left_semi")
    return met.unionByName(one.where("at2 is null")).select("item", "key", "shift").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = 10, near: int | None = None) -> DataFrame:
    """`matches` of documents whose postings are not stored yet."""
    terms = materialise(item_terms(items))
    return matches(build_postings(docs, terms.select("term").distinct()), terms, window, near)


def matches(stored: DataFrame, terms: DataFrame, window: int = 10, near: int | None = None) -> DataFrame:
    """(key, item_id, first_pos, last_pos, exact): where a document holds `window` consecutive words of an item.

    stored: postings (`build_postings`); terms: the items' words (`item_terms`).

    Overlapping windows of one alignment are one row. An item of fewer words is matched whole. With `near`, rows with
    exact = false are added: alignments without an exact phrase in which one window has at least `near` words in place.
    """
    names = terms.select("item", "item_id").distinct()
    postings = posted_terms(stored)
    places = materialise(alignments(postings, terms, window, 0 if near is None else max(0, window - near)))
    expected = places.join(terms, "item").select("item", "key", "shift", "n", "at", "term", (F.col("shift") + F.col("at")).alias("pos"))
    agreed = expected.join(postings, ["key", "pos", "term"]).select("item", "key", "shift", "n", "at").distinct()
    line = Window.partitionBy("item", "key", "shift").orderBy("at")
    runs = (
        agreed.withColumn("run", F.col("at") - F.row_number().over(line))
        .groupBy("item", "key", "shift", "n", "run").agg(F.min("at").alias("a"), F.max("at").alias("b"))
        .where(F.col("b") - F.col("a") + 1 >= F.least(F.lit(window), F.col("n")))
    )
    found = runs.select("key", "item", "shift", "a", "b", F.lit(True).alias("exact"))
    if near is not None:
        span = line.rangeBetween(-(window - 1), Window.currentRow)
        close = (
            agreed.withColumn("held", F.count("*").over(span)).where(F.col("held") >= near)
            .groupBy("item", "key", "shift").agg(F.greatest(F.lit(0), F.min("at") - (window - 1)).alias("a"), F.max("at").alias("b"))
            .join(runs.select("item", "key", "shift").distinct(), ["item", "key", "shift"], "left_anti")
        )
        found = found.unionByName(close.select("key", "item", "shift", "a", "b", F.lit(False).alias("exact")))
    return found.join(names, "item").select(
        "key", "item_id", (F.col("a") + F.col("shift")).alias("first_pos"), (F.col("b") + F.col("shift")).alias("last_pos"), "exact"
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document row: doc_id, key, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated.

    A word is hit if any occurrence of any window covers it. Null texts and items have no words; an item_id that
    stands on several rows is one item with all their windows; an item without id hits words but isn't named; repeated document rows each get their result; empty
    tables give no rows or no hits; further columns are not read.
    """
    terms = materialise(item_terms(items))
    stored = build_postings(docs, terms.select("term").distinct())
    found = materialise(matches(stored, terms, window).select("key", "item_id", "first_pos", "last_pos"))
    hit = (
        found.select("key", F.explode(F.sequence("first_pos", "last_pos")).alias("pos")).distinct()
        .groupBy("key").agg(F.count("*").alias("n_hit"))
    )
    held = (
        found.select("key", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    )
    rows = posted_documents(stored)
    return (
        rows.join(hit, "key", "left").join(held, "key", "left")
        .select(
            "doc_id", "key", "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """`docs` without the rows that hold an item's window; all columns stay, whatever their names.

    Rows with a null or empty text hold none and stay; repeated rows go or stay together; very long texts are read
    whole; an empty table, or no items, leaves `docs` as it is.
    """
    name = f"_key_{uuid.uuid4().hex}"  # clashes with no column of docs
    bad = phrase_matches(docs, items, window).select(F.col("key").alias(name)).distinct()
    return docs.join(bad, row_key(docs) == F.col(name), "left_anti")
