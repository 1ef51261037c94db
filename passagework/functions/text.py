"""Text columns: normal forms, script profile, language, keys, quality flags.

Every function takes and returns Columns made of built-in expressions, so the
work stays in the JVM and adds no shuffle. Patterns name their character classes
outright because the regex shorthands are ASCII-only in Java.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import vocab as V

# Characters that may stand in text that is not in composed normal form: marks
# outside the stripped classes, conjoining Hangul, singletons and compatibility
# ideographs. Only rows holding one of them pay for composition.
_MAYBE_UNCOMPOSED = (
    r"[[\u0300-\x{10ffff}]&&[\p{M}\u0340\u0341\u0343\u0344\u0374\u037e\u0387\u1161-\u1175\u11a8-\u11c2\u1f00-\u1fff"
    r"\u2000\u2001\u2126\u212a\u212b\u2329\u232a\uf900-\ufaff\ufb1d-\ufb4f]]"
)

#: One white-space character. The visible ASCII characters, none of which is one, are ruled out by a single
#: range before the many ranges of the class are looked at, which is most of what a pattern costs on Latin text.
SPACE = rf"[[\x00-\x20\x7f-\uffff]&&[{V.WHITESPACE}]]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_list(values: Sequence[str]) -> Column:
    """A literal array of strings, folded by the optimizer from one literal."""
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit("\x01".join(values)), "\x01")


def literal(value: object, schema: str) -> Column:
    """A literal of any type, folded by the optimizer from one JSON literal."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def unnest(df: DataFrame, keep: Sequence, array: Column | str, name: str, pos: str | None = None) -> DataFrame:
    """One row per element, other columns as in `keep`; empty arrays give none.

    A plain explode makes the optimizer infer a filter on the array's size and
    push it below, which computes a costly array twice. The outer form does not.
    """
    if pos is None:
        return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).filter(F.col(pos).isNotNull())


# --------------------------------------------------------------------------
# Single steps
# --------------------------------------------------------------------------

def compose(c: Column | str) -> Column:
    """Canonical composition (NFC), through the ICU class Spark itself ships."""
    c = _col(c)
    nfc = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike(_MAYBE_UNCOMPOSED), nfc).otherwise(c)


def _delete(c: Column | str, chars: str) -> Column:
    return F.regexp_replace(_col(c), f"[{chars}]", "")


def _fold(c: Column | str, table: dict[str, str]) -> Column:
    return F.translate(_col(c), "".join(table), "".join(table.values()))


def strip_diacritics(c: Column | str) -> Column:
    return _delete(c, V.DIACRITICS + V.TATWEEL)


def strip_waqf_marks(c: Column | str) -> Column:
    return _delete(c, V.WAQF_MARKS)


def strip_ornaments(c: Column | str) -> Column:
    return _delete(c, V.ORNAMENTS)


def unify_alef(c: Column | str) -> Column:
    return _fold(c, V.ALEF_FOLDS)


def unify_letters(c: Column | str) -> Column:
    return _fold(c, V.LETTER_FOLDS)


def normalize_digits(c: Column | str) -> Column:
    return _fold(c, V.DIGIT_FOLDS)


def normalize_punctuation(c: Column | str) -> Column:
    return _fold(c, V.PUNCTUATION_FOLDS)


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, at both ends."""
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


def collapse_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), f"{SPACE}+", " "))


def is_blank(c: Column | str) -> Column:
    c = _col(c)
    return c.isNull() | ~c.rlike(f"[^{V.WHITESPACE}]")


def words(c: Column | str) -> Column:
    """Words of a text whose white space is already collapsed."""
    return F.filter(F.split(_col(c), " "), lambda w: w != "")


# --------------------------------------------------------------------------
# Normal forms
# --------------------------------------------------------------------------

def _expand(chars: str) -> str:
    """All characters of a class written as escapes and ranges."""
    out: list[str] = []
    for m in re.finditer(r"\\u([0-9a-f]{4})(?:-\\u([0-9a-f]{4}))?", chars):
        first = int(m[1], 16)
        out.extend(map(chr, range(first, int(m[2] or m[1], 16) + 1)))
    return "".join(out)


_ALL_FOLDS = {**V.ALEF_FOLDS, **V.LETTER_FOLDS, **V.DIGIT_FOLDS, **V.PUNCTUATION_FOLDS}
_DROPPED = _expand(V.ORNAMENTS + V.DIACRITICS + V.TATWEEL + V.HAMZA)

# Text without a character from here up (and without guillemets) is already in
# both normal forms but for its white space, which covers most Latin text.
_BEYOND_LATIN = r"[\u0300-\x{10ffff}]"
_MAY_FOLD = r"[\u00ab\u00bb\u0300-\x{10ffff}]"


def _fold_letters(c: Column) -> Column:
    # No deletion yields a folded letter and no fold a deleted one, so a single
    # translate (letters without a counterpart are deleted) does both.
    return F.translate(c, "".join(_ALL_FOLDS) + _DROPPED, "".join(_ALL_FOLDS.values()))


def fold_composed(c: Column | str) -> Column:
    """Matching form of text that is already composed; usable inside lambdas."""
    c = _col(c)
    return collapse_whitespace(F.when(c.rlike(_MAY_FOLD), _fold_letters(c)).otherwise(c))


def matching_form(c: Column | str) -> Column:
    """Form used only for matching; never displayed."""
    c = _col(c)
    return collapse_whitespace(F.when(c.rlike(_MAY_FOLD), _fold_letters(compose(c))).otherwise(c))


def display_form(c: Column | str) -> Column:
    """Form shown to readers: orthography kept, invisible characters dropped."""
    c = _col(c)
    return collapse_whitespace(F.when(c.rlike(_BEYOND_LATIN), strip_ornaments(compose(c))).otherwise(c))


def _key_of_matching(m: Column) -> Column:
    spaced = F.regexp_replace(m, rf"[^\p{{L}}\p{{N}}_{V.WHITESPACE}\u0621-\u06ff]", " ")
    return collapse_whitespace(F.lower(spaced))


def key_form(c: Column | str) -> Column:
    """Matching form without punctuation, lower case: names and titles."""
    return _key_of_matching(matching_form(c))


def key_form_composed(c: Column | str) -> Column:
    """`key_form` for composed text; usable inside lambdas."""
    return _key_of_matching(fold_composed(c))


def with_text_forms(df: DataFrame, column: str) -> DataFrame:
    """Add `display` and `matching` beside the original, which stays untouched."""
    return df.withColumns({"display": display_form(column), "matching": matching_form(column)})


# --------------------------------------------------------------------------
# Script and language
# --------------------------------------------------------------------------

def has_arabic(c: Column | str) -> Column:
    return _col(c).rlike(f"[{V.ARABIC_LETTERS}]")


def arabic_ratio(c: Column | str) -> Column:
    """Arabic letters over all letters (tatweel left out); 0 without letters."""
    c = _col(c)
    arabic = F.regexp_count(c, F.lit(f"[{V.ARABIC_LETTERS}]"))
    letters = F.regexp_count(c, F.lit(rf"[\p{{L}}&&[^{V.TATWEEL}]]"))
    return F.when(letters > 0, arabic / letters).otherwise(F.lit(0.0))


def detect_language(c: Column | str, default: Column | str = "en") -> Column:
    """struct(language, confidence, reason) for Arabic, English or Urdu text."""
    text = strip(c)
    fallback = F.lit(default) if isinstance(default, str) else default
    latin = text.rlike("[A-Za-z]")
    markers = F.regexp_count(text, F.lit(f"[{V.URDU_LETTERS}]"))
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\u0600-\u06ff]+"), F.lit(0)))
    urdu = F.size(F.array_intersect(tokens, word_list(V.URDU_FUNCTION_WORDS)))
    arabic = F.size(F.array_intersect(tokens, word_list(V.ARABIC_FUNCTION_WORDS)))

    def verdict(language, confidence, reason) -> Column:
        return F.struct(
            (F.lit(language) if isinstance(language, str) else language).alias("language"),
            (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"),
            (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        )

    marker_confidence = F.round(F.least(F.lit(0.99), 0.80 + 0.05 * markers), 2)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", verdict(fallback, 0.0, "empty input"))
        .when(~has_arabic(text) & latin, verdict("en", 0.95, "latin script"))
        .when(~has_arabic(text), verdict(fallback, 0.2, "no linguistic content"))
        .when((arabic_ratio(text) < 0.5) & latin, verdict("en", 0.7, "latin-dominant mixed script"))
        .when(
            markers > 0,
            verdict("ur", marker_confidence,
                    F.concat(markers.cast("string"), F.lit(" urdu-specific letter(s)"))),
        )
        .when(urdu > arabic, verdict("ur", 0.75, "urdu function words"))
        .when(arabic > 0, verdict("ar", 0.90, "arabic function words"))
        .otherwise(verdict("ar", 0.60, "arabic script, no marker"))
    )


def arabic_fragments(c: Column | str) -> Column:
    """Runs of three or more Arabic-block or space characters, trimmed."""
    runs = F.regexp_extract_all(_col(c), F.lit(rf"[\u0600-\u06ff{V.WHITESPACE}]{{3,}}"), F.lit(0))
    return F.filter(F.transform(runs, strip), lambda x: x != "")


# --------------------------------------------------------------------------
# Names
# --------------------------------------------------------------------------

def _fold_latin(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(.)\1+", "$1"), "h$", "")


def latin_key(c: Column | str, articles: Sequence[str] = V.LATIN_ARTICLES) -> Column:
    """Comparison key of a transliterated name, leading article dropped."""
    parts = F.transform(
        F.split(F.lower(_col(c)), rf"[{V.WHITESPACE}\-_']+"),
        lambda p: F.regexp_replace(p, "[^a-z]", ""),
    )
    # A trailing separator keeps every part closed, so one pattern drops the
    # article only when something follows it.
    joined = F.array_join(F.filter(parts, lambda p: p != ""), " ")
    bare = F.regexp_replace(joined, f"^(?:{'|'.join(articles)}) (?=.)", "")
    return _fold_latin(F.replace(bare, F.lit(" "), F.lit("")))


def latin_key_with_article(c: Column | str) -> Column:
    return _fold_latin(F.regexp_replace(F.lower(_col(c)), "[^a-z]", ""))


def historical_period(death_year: Column | str) -> Column:
    y = _col(death_year)
    return (
        F.when(y.isNull(), "UNKNOWN")
        .when(y <= 150, "FORMATIVE")
        .when(y <= 400, "EARLY")
        .when(y <= 700, "CLASSICAL")
        .when(y <= 1000, "MEDIEVAL")
        .when(y <= 1300, "LATER")
        .otherwise("MODERN")
    )


# --------------------------------------------------------------------------
# Content words, gists, sentences
# --------------------------------------------------------------------------

def content_words(
    matching: Column | str,
    *,
    stop_words: Sequence[str] = V.SUPPORT_STOP_WORDS,
    clitics: Sequence[str] = V.CLITICS,
    min_word: int = 4,
    min_stem: int = 3,
) -> Column:
    """Distinct stems that carry meaning, from a matching form."""
    long_words = F.array_except(
        F.array_distinct(F.filter(F.split(_col(matching), " "), lambda w: F.length(w) >= min_word)),
        word_list(stop_words),
    )
    prefix = rf"^(?:{'|'.join(clitics)})(?=.{{{min_stem},}})"
    stems = F.transform(long_words, lambda w: F.regexp_replace(w, prefix, ""))
    return F.array_distinct(F.filter(stems, lambda w: F.length(w) >= min_stem))


def _any_of(phrases: Sequence[str]) -> str:
    return "|".join(phrases)


#: A quotation in ornate or curly brackets; the group is what was quoted.
BRACKETS = [r"﴿([^﴾]{2,200})﴾", r"\{([^{}]{4,200})\}"]


def opens_discussion(
    c: Column | str,
    *,
    headers: Sequence[str] = V.CLAUSE_HEADERS,
    brackets: Sequence[str] = BRACKETS,
    window: int = 160,
) -> Column:
    """True when a header or a whole quotation lies inside the opening window."""
    head = F.substring(collapse_whitespace(c), 1, window)
    return head.rlike(_any_of(headers)) | head.rlike(_any_of(brackets))


def gist(
    c: Column | str,
    *,
    headers: Sequence[str] = V.CLAUSE_HEADERS,
    limit: int = 180,
    earliest: int = 40,
    marks: Sequence[str] = ("۔", ".", "،"),
) -> Column:
    """Opening line of a passage without its header and quotation."""
    whole = collapse_whitespace(c)
    body = F.regexp_replace(whole, rf"^(?:{_any_of(headers)})[ :،]*", "")
    body = F.regexp_replace(body, r"^﴿[^﴾]*﴾[ ]*[:،]?[ ]*", "")
    body = F.regexp_replace(body, r"^\[\[.*?\]\] *", "")
    text = F.when(is_blank(body), whole).otherwise(body)
    cut = F.coalesce(
        *[
            F.when(
                F.locate(mark, text, earliest + 1).between(1, limit + 1),
                F.trim(F.substring(text, F.lit(1), F.locate(mark, text, earliest + 1))),
            )
            for mark in marks
        ]
    )
    tail = F.when(
        F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("…"))
    ).otherwise(F.trim(text))
    return F.coalesce(cut, tail)


def pack(pieces: Column, limit: int | Column, joiner: str = " ") -> Column:
    """Join neighbouring pieces greedily while the joined length fits `limit`.

    A single piece longer than the limit stays whole. `done` and `open` are the
    closed packs and the one being filled.
    """
    room = F.lit(limit) if isinstance(limit, int) else limit
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("open")
    )

    def step(acc: Column, piece: Column) -> Column:
        full = F.length(acc["open"]) + F.length(piece) + len(joiner) > room
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), piece.alias("open")))
            .when(
                full,
                F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), piece.alias("open")),
            )
            .otherwise(
                F.struct(
                    acc["done"].alias("done"),
                    F.concat(acc["open"], F.lit(joiner), piece).alias("open"),
                )
            )
        )

    return F.aggregate(
        pieces, start, step,
        lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(
            F.array_append(acc["done"], acc["open"])
        ),
    )


def split_sentences(c: Column | str, *, limit: int = 400) -> Column:
    """Sentences; one longer than `limit` is re-packed from its clauses."""
    sentences = F.filter(
        F.transform(
            F.split(collapse_whitespace(c), r"(?<=[.؟!۔:]) "), lambda s: F.trim(s)
        ),
        lambda s: s != "",
    )
    pieces = F.transform(
        sentences,
        lambda s: F.when(F.length(s) <= limit, F.array(s)).otherwise(
            F.transform(
                pack(F.split(s, r"(?<=[,،؛]) "), limit), lambda p: F.trim(p)
            )
        ),
    )
    return F.flatten(pieces)


# --------------------------------------------------------------------------
# Degenerate output
# --------------------------------------------------------------------------

def flag_degenerate(
    df: DataFrame,
    column: str,
    *,
    min_words: int = 12,
    max_share: float = 0.35,
    max_repeats: int = 8,
) -> DataFrame:
    """Add `degenerate` and `degenerate_reason`: one word dominating, or a phrase looping.

    A word holding more than `max_share` of the sorted words must cover one of
    the positions that split them into runs of that length, so only those few
    candidates are counted instead of every distinct word.
    """
    w = F.col("_words")
    n = F.size(w)
    steps = [F.floor(n * (max_share * k)).cast("int") for k in range(1, int(1 / max_share) + 1)]
    candidates = F.array_distinct(
        F.transform(
            F.array(*[F.least(s, n - 1) for s in steps]),
            lambda i: F.get(F.col("_sorted"), i),
        )
    )
    counted = F.transform(
        candidates,
        lambda c: F.struct(
            F.size(F.filter(w, lambda x: x == c)).alias("n"),
            (-F.array_position(w, c)).alias("first"),
            c.alias("word"),
        ),
    )

    def loops(size: int) -> Column:
        blocks = F.col(f"_blocks{size}")
        k = F.size(blocks)
        same = F.zip_with(
            F.slice(blocks, F.lit(2), F.greatest(k - 1, F.lit(0))),
            F.slice(blocks, F.lit(1), F.greatest(k - 1, F.lit(0))),
            lambda a, b: F.when(a == b, "1").otherwise("0"),
        )
        return F.contains(F.array_join(same, ""), F.lit("1" * (max_repeats - 1)))

    def blocks(size: int) -> Column:
        if size == 1:
            return w
        count = F.floor(n / size).cast("int")
        return F.when(
            count > 0,
            F.transform(
                F.sequence(F.lit(0), count - 1),
                lambda b: F.concat_ws(" ", F.slice(w, b * size + 1, F.lit(size))),
            ),
        ).otherwise(F.array().cast("array<string>"))

    share = F.col("_top.n") / n
    dominated = share > max_share
    reason = F.when(n < min_words, F.lit(None).cast("string")).when(
        dominated,
        F.concat(
            F.lit("token '"), F.col("_top.word"), F.lit("' is "),
            F.round(share * 100, 0).cast("int").cast("string"), F.lit("% of the output"),
        ),
    )
    for size in (1, 2, 3):
        reason = reason.when(loops(size), f"{size}-word phrase repeats {max_repeats}+ times")
    scratch = ["_words", "_sorted", "_top", "_blocks1", "_blocks2", "_blocks3"]
    return (
        df.withColumn("_words", words(collapse_whitespace(column)))
        .withColumn("_sorted", F.array_sort("_words"))
        .withColumns({f"_blocks{s}": blocks(s) for s in (1, 2, 3)})
        .withColumn("_top", F.when(n >= min_words, F.array_max(counted)))
        .withColumn("degenerate_reason", reason)
        .withColumn("degenerate", F.col("degenerate_reason").isNotNull())
        .drop(*scratch)
    )
