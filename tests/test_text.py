import unicodedata

import pytest
from pyspark.sql import functions as F

from passagework.functions import text as T


def values(spark, inputs, build):
    rows = [(i, x) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", build("t").alias("v"))
    return [r.v for r in df.orderBy("i").collect()]


def test_matching_pairs(spark):
    pairs = [
        ("إبراهيم", "ابراهيم"), ("أبراهيم", "ابراهيم"), ("آبراهيم", "ابراهيم"),
        ("ٱبراهيم", "ابراهيم"), ("مكة", "مكه"), ("موسى", "موسي"), ("مسئول", "مسيول"),
        ("مؤمن", "مومن"), ("کتاب", "كتاب"), ("  الله   أكبر  ", "الله اكبر"),
        ("é", "é"), ("Å", "Å"), ("«a» – b", '"a" - b'),
    ]
    assert values(spark, [a for a, _ in pairs], T.matching_form) == [b for _, b in pairs]


def test_display_is_nfc_and_keeps_marks(spark):
    raw = ["éx​  y", "آ", "بً"]
    got = values(spark, raw, T.display_form)
    assert got == [unicodedata.normalize("NFC", s) for s in ("éx y", "آ", "بً")]


def test_steps(spark):
    assert values(spark, ["الرحمـــن"], T.strip_diacritics) == ["الرحمن"]
    assert values(spark, ["٢٥٥", "۲۵۵"], T.normalize_digits) == ["255", "255"]
    keys = values(spark, ["البقرة، ٢٥٥", "البقرة 255", "Al-Baqarah", "al baqarah"], T.key_form)
    assert keys[0] == keys[1] and keys[2] == keys[3]


def test_script_profile(spark):
    assert values(spark, ["الرحمـــن", "hello world", "2:255"], T.arabic_ratio) == [1.0, 0.0, 0.0]
    assert values(spark, ["اردو", "abc"], T.has_arabic) == [True, False]


@pytest.mark.parametrize(
    "text,language",
    [
        ("What does الحي القيوم mean in this verse of the book", "en"),
        ("كتاب", "ar"),
        ("اس آیت کی تفسیر کیا ہے", "ur"),
        ("", "fr"), ("2:255", "fr"),
    ],
)
def test_language(spark, text, language):
    [got] = values(spark, [text], lambda c: T.detect_language(c, "fr"))
    assert got.language == language
    if language == "fr":
        assert got.confidence < 0.5


def test_latin_keys(spark):
    names = ["Al-Baqarah", "Al-Baqara", "An-Naas", "Naas", "al-nas", "Al-Faatiha", "Al"]
    assert values(spark, names, T.latin_key) == ["baqara", "baqara", "nas", "nas", "nas", "fatiha", "al"]


def test_content_words(spark):
    got = values(spark, ["والقيوم القيوم وهو كتابه بكت"], T.content_words)
    assert sorted(got[0]) == sorted({"قيوم", "تابه"})


def test_opening_and_gist(spark):
    text = "قوله تعالى: ﴿الحي القيوم﴾ " + "كلام " * 30 + "."
    assert values(spark, [text, "x" * 170 + "قوله تعالى"], T.opens_discussion) == [True, False]
    [g] = values(spark, [text], T.gist)
    assert g.startswith("كلام") and len(g) <= 181


def test_sentence_split_limits(spark):
    long = ", ".join(["clause of some words"] * 40) + ". Short one. "
    [got] = values(spark, [long], T.split_sentences)
    assert all(len(p) <= 400 for p in got) and got[-1] == "Short one."
    assert " ".join(got) == long.strip()


def test_degenerate(spark):
    good = " ".join(f"w{i}" for i in range(40))
    cases = [
        (good, None),
        ("a b a c a d a e a f a g", "token 'a' is 50% of the output"),
        ("p q r " * 8 + good, "3-word phrase repeats 8+ times"),
        ("p q r " * 7 + good, None),
        ("z " * 8 + good, "1-word phrase repeats 8+ times"),
        ("a a a", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = T.flag_degenerate(df, "t").orderBy("i").collect()
    assert [r.degenerate_reason for r in got] == [r for _, r in cases]


def test_white_space_is_ruled_out_by_one_range_first(spark):
    """`SPACE` is the class of white space, and composition looks at the same characters, with the common ones ruled out first."""
    rows = spark.range(0xFFFF).filter("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    assert rows.filter(F.col("c").rlike(T.SPACE) != F.col("c").rlike(f"[{T.V.WHITESPACE}]")).count() == 0
    marks = T._MAYBE_UNCOMPOSED.split("&&", 1)[1][:-1]
    assert rows.filter(F.col("c").rlike(T._MAYBE_UNCOMPOSED) != F.col("c").rlike(marks)).count() == 0
    assert rows.filter(F.col("c").rlike(T.SPACE)).count() > 20
