"""Splitting commentary entries into passages along their own structure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions import vocab as V

TARGET_CHARS = 1200
MAX_CHARS = 2200
MIN_CHARS = 120

_W = T.SPACE
#: Lines that separate reports in printed editions.
SEPARATOR = rf"\n{_W}*\*{_W}*\*{_W}*\n|\n{_W}*-{{3,}}{_W}*\n|\n{_W}*={{3,}}{_W}*\n"
SENTENCE_END = rf"(?<=[.؟!۔]){_W}+"


def _non_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, T.strip), lambda p: p != "")


def structural_units(c: Column | str, headers: Sequence[str] = V.UNIT_HEADERS) -> Column:
    """Paragraphs of every section, a unit header always opening a new one."""
    sections = F.split(c, SEPARATOR)
    opening = rf"(?:^|\n)\n*({_W}*(?:{'|'.join(headers)}))"
    return F.flatten(
        F.transform(
            sections,
            lambda s: _non_blank(F.split(F.regexp_replace(s, opening, "\n\n$1"), rf"\n{_W}*\n")),
        )
    )


def _bounded_units(units: Column, max_chars: int, packed_to: int) -> Column:
    def pieces(unit: Column) -> Column:
        sentences = F.filter(F.split(unit, SENTENCE_END), lambda s: ~T.is_blank(s))
        packed = F.transform(T.pack(sentences, packed_to), T.strip)
        return F.when(F.length(unit) <= max_chars, F.array(unit)).otherwise(packed)

    return F.flatten(F.transform(units, pieces))


def chunk_documents(
    df: DataFrame,
    text: str,
    *,
    target: int = TARGET_CHARS,
    max_chars: int = MAX_CHARS,
    min_chars: int = MIN_CHARS,
    headers: Sequence[str] = V.UNIT_HEADERS,
) -> DataFrame:
    """Explode entries into chunks; all other columns are kept.

    Adds chunk_index, raw_text, matching, display, char_count. Entries never share
    a chunk and blank entries yield none. One row is worked on at a time, so the
    job adds no shuffle.
    """
    kept = [c for c in df.columns if c != text]
    chunks = T.pack(F.col("_units"), target, "\n\n")
    last, rest = F.element_at("_chunks", -1), F.slice("_chunks", 1, F.size("_chunks") - 2)
    folded = F.when(
        (F.size("_chunks") > 1) & (F.length(last) < min_chars),
        F.array_append(rest, F.concat(F.element_at("_chunks", -2), F.lit("\n\n"), last)),
    ).otherwise(F.col("_chunks"))
    units = _bounded_units(structural_units(F.col(text), headers), max_chars, TARGET_CHARS)
    packed = (
        df.filter(~T.is_blank(text))
        .select(*kept, units.alias("_units"))
        .select(*kept, chunks.alias("_chunks"))
    )
    out = T.unnest(packed, kept, folded, "raw_text", "chunk_index")
    return T.with_text_forms(out, "raw_text").withColumn("char_count", F.length("raw_text"))
