"""DuckDB spellings of the text steps, for the oracle side only."""

from __future__ import annotations

import re

from passagework.functions import vocab as V


def re2(chars: str) -> str:
    """Java \\uXXXX escapes as RE2 ones."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", chars)


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


WS = re2(V.WHITESPACE)
DROPPED = re2(V.ORNAMENTS + V.DIACRITICS + V.TATWEEL + V.HAMZA)
FOLDS = {**V.ALEF_FOLDS, **V.LETTER_FOLDS, **V.DIGIT_FOLDS, **V.PUNCTUATION_FOLDS}


def replace_all(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def delete(x: str, chars: str) -> str:
    return replace_all(x, f"[{re2(chars)}]", "")


def fold(x: str, table: dict[str, str]) -> str:
    src = "".join(table).replace("'", "''")
    dst = "".join(table.values()).replace("'", "''")
    return f"translate({x}, '{src}', '{dst}')"


def collapse(x: str) -> str:
    return f"trim({replace_all(x, f'[{WS}]+', ' ')})"


def strip(x: str) -> str:
    return replace_all(x, f"^[{WS}]+|[{WS}]+$", "")


def matching(x: str) -> str:
    return collapse(fold(f"regexp_replace(nfc_normalize({x}), '[{DROPPED}]', '', 'g')", FOLDS))


def display(x: str) -> str:
    return collapse(delete(f"nfc_normalize({x})", V.ORNAMENTS))


def key(x: str) -> str:
    spaced = replace_all(matching(x), f"[^\\p{{L}}\\p{{N}}_{WS}\\x{{0621}}-\\x{{06ff}}]", " ")
    return collapse(f"lower({spaced})")


def latin_key(x: str) -> str:
    parts = f"list_transform(regexp_split_to_array(lower({x}), '[{WS}\\-_'']+'), lambda p: regexp_replace(p, '[^a-z]', '', 'g'))"
    joined = f"array_to_string(list_filter({parts}, lambda p: p <> ''), ' ')"
    out = f"replace(regexp_replace({joined}, '^(?:{'|'.join(V.LATIN_ARTICLES)}) ', ''), ' ', '')"
    for letter in "abcdefghijklmnopqrstuvwxyz":
        out = f"regexp_replace({out}, '{letter}{letter}+', '{letter}', 'g')"
    return f"regexp_replace({out}, 'h$', '')"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def tokens(m: str) -> str:
    return f"regexp_extract_all(lower({m}), '[\\p{{L}}\\p{{N}}]+')"


def content_words(m: str, stop=V.SUPPORT_STOP_WORDS, clitics=V.CLITICS) -> str:
    long_words = (
        f"list_filter(string_split({m}, ' '), "
        f"lambda w: length(w) >= 4 and not list_contains([{quoted(stop)}], w))"
    )
    stems = (
        f"list_transform({long_words}, "
        f"lambda w: regexp_replace(w, '^(?:{'|'.join(clitics)})(.{{3,}})$', '\\1'))"
    )
    return f"list_distinct(list_filter({stems}, lambda w: length(w) >= 3))"
