"""Registered queries: text jobs (B) and chunking (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions import vocab as V
from passagework.operators.chunking import chunk_documents
from passagework.plans import sql_text as S
from passagework.plans.driver_views import with_views
from passagework.plans.registry import query


@query("b1_matching_form", with_views(f"SELECT doc_id, {S.matching('text')} AS matching FROM v_scripted"))
def b1(c):
    return c.scripted.select("doc_id", T.matching_form("text").alias("matching"))


@query("b2_display_form", with_views(f"SELECT doc_id, {S.display('text')} AS display FROM v_scripted"))
def b2(c):
    return c.scripted.select("doc_id", T.display_form("text").alias("display"))


@query("b3_key_form", with_views(f"SELECT doc_id, {S.key('text')} AS key FROM v_scripted"))
def b3(c):
    return c.scripted.select("doc_id", T.key_form("text").alias("key"))


@query(
    "b4_single_steps",
    with_views(f"""
    SELECT doc_id, length({S.delete('text', V.DIACRITICS + V.TATWEEL)}) AS no_diacritics,
      length({S.delete('text', V.WAQF_MARKS)}) AS no_waqf, length({S.delete('text', V.ORNAMENTS)}) AS no_ornaments,
      md5({S.fold('text', V.ALEF_FOLDS)}) AS alef, md5({S.fold('text', V.LETTER_FOLDS)}) AS letters,
      md5({S.fold('text', V.DIGIT_FOLDS)}) AS digits, md5({S.fold('text', V.PUNCTUATION_FOLDS)}) AS punctuation,
      md5({S.collapse('text')}) AS collapsed
    FROM v_scripted"""),
)
def b4(c):
    return c.scripted.select(
        "doc_id",
        F.length(T.strip_diacritics("text")).alias("no_diacritics"),
        F.length(T.strip_waqf_marks("text")).alias("no_waqf"),
        F.length(T.strip_ornaments("text")).alias("no_ornaments"),
        F.md5(T.unify_alef("text")).alias("alef"),
        F.md5(T.unify_letters("text")).alias("letters"),
        F.md5(T.normalize_digits("text")).alias("digits"),
        F.md5(T.normalize_punctuation("text")).alias("punctuation"),
        F.md5(T.collapse_whitespace("text")).alias("collapsed"),
    )


_AR = f"[{S.re2(V.ARABIC_LETTERS)}]"
_RATIO = f"""CASE WHEN n_letters > 0 THEN n_arabic / CAST(n_letters AS DOUBLE) ELSE 0.0 END"""
_PROFILE = f"""
    SELECT doc_id, text, length(text) - length(regexp_replace(text, '{_AR}', '', 'g')) AS n_arabic,
      length(regexp_replace(text, '\\x{{0640}}', '', 'g')) -
        length(regexp_replace(regexp_replace(text, '\\x{{0640}}', '', 'g'), '\\p{{L}}', '', 'g')) AS n_letters
    FROM v_scripted"""


@query(
    "b5_script_profile",
    with_views(
        f"SELECT doc_id, n_arabic > 0 AS has_arabic, round({_RATIO}, 6) AS arabic_ratio FROM v_profile",
        ("v_profile", _PROFILE),
    ),
)
def b5(c):
    return c.scripted.select(
        "doc_id", T.has_arabic("text").alias("has_arabic"), F.round(T.arabic_ratio("text"), 6).alias("arabic_ratio")
    )


_URDU = f"[{S.re2(V.URDU_LETTERS)}]"
_SIGNALS = f"""
    SELECT doc_id, n_arabic, {_RATIO} AS ratio, {S.strip('text')} AS t,
      length(text) - length(regexp_replace(text, '{_URDU}', '', 'g')) AS markers,
      len(list_intersect(regexp_extract_all(text, '[\\x{{0600}}-\\x{{06ff}}]+'), [{S.quoted(V.URDU_FUNCTION_WORDS)}])) AS urdu,
      len(list_intersect(regexp_extract_all(text, '[\\x{{0600}}-\\x{{06ff}}]+'), [{S.quoted(V.ARABIC_FUNCTION_WORDS)}])) AS arabic,
      regexp_matches(text, '[A-Za-z]') AS latin
    FROM v_profile"""


@query(
    "b6_detect_language",
    with_views(
        """
    SELECT doc_id,
      CASE WHEN t = '' THEN 'en' WHEN n_arabic = 0 THEN 'en' WHEN ratio < 0.5 AND latin THEN 'en'
        WHEN markers > 0 THEN 'ur' WHEN urdu > arabic THEN 'ur' ELSE 'ar' END AS language,
      CAST(CASE WHEN t = '' THEN 0.0 WHEN n_arabic = 0 AND latin THEN 0.95 WHEN n_arabic = 0 THEN 0.2
        WHEN ratio < 0.5 AND latin THEN 0.7 WHEN markers > 0 THEN round(least(0.99, 0.80 + 0.05 * markers), 2)
        WHEN urdu > arabic THEN 0.75 WHEN arabic > 0 THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence,
      CASE WHEN t = '' THEN 'empty input' WHEN n_arabic = 0 AND latin THEN 'latin script'
        WHEN n_arabic = 0 THEN 'no linguistic content' WHEN ratio < 0.5 AND latin THEN 'latin-dominant mixed script'
        WHEN markers > 0 THEN markers || ' urdu-specific letter(s)' WHEN urdu > arabic THEN 'urdu function words'
        WHEN arabic > 0 THEN 'arabic function words' ELSE 'arabic script, no marker' END AS reason
    FROM v_signals""",
        ("v_profile", _PROFILE), ("v_signals", _SIGNALS),
    ),
)
def b6(c):
    return c.scripted.select("doc_id", T.detect_language("text").alias("d")).select("doc_id", "d.*")


# Backreferences are beyond the oracle's regex engine: rows only.
def _folded(name: str) -> str:
    """Runs of one letter as one, and no closing h."""
    return f"""regexp_replace(array_to_string(list_transform(range(length({name})), lambda i: CASE WHEN i > 0 AND
        substr({name}, i + 1, 1) = substr({name}, i, 1) THEN '' ELSE substr({name}, i + 1, 1) END), ''), 'h$', '')"""


_ARTICLES = "|".join(V.LATIN_ARTICLES)


@query(
    "b7_latin_keys",
    f"""SELECT c_custkey, {_folded("bare")} AS latin_key, {_folded("whole")} AS latin_key_with_article FROM (
      SELECT c_custkey, whole, replace(CASE WHEN regexp_matches(joined, '^({_ARTICLES}) .') THEN regexp_replace(joined, '^({_ARTICLES}) ', '') ELSE joined END, ' ', '') AS bare
      FROM (SELECT c_custkey, regexp_replace(lower(name), '[^a-z]', '', 'g') AS whole,
          array_to_string(list_filter(list_transform(regexp_split_to_array(lower(name), '[ _-]+'), lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w: w <> ''), ' ') AS joined
        FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'al-' || c_mktsegment || 'h' WHEN 1 THEN 'Ash ' || c_name ELSE c_name END AS name FROM customer) n) x) y""",
)
def b7(c):
    k = F.col("c_custkey")
    name = (
        F.when(k % 3 == 0, F.concat(F.lit("al-"), "c_mktsegment", F.lit("h")))
        .when(k % 3 == 1, F.concat(F.lit("Ash "), "c_name")).otherwise(F.col("c_name"))
    )
    named = c.table("customer").select("c_custkey", name.alias("name"))
    return named.select(
        "c_custkey", T.latin_key("name").alias("latin_key"), T.latin_key_with_article("name").alias("latin_key_with_article")
    )




def degenerate_views(texts: str) -> tuple[tuple[str, str], ...]:
    """Oracle views over `texts` (doc_id, text): v_degenerate(doc_id, reason)."""
    loops = " UNION ALL ".join(
        f"""SELECT DISTINCT doc_id, {size} AS size FROM (
          SELECT doc_id, b - row_number() OVER (PARTITION BY doc_id ORDER BY b) AS island FROM (
            SELECT doc_id, b, k = {size} AND block = lag(block) OVER (PARTITION BY doc_id ORDER BY b) AS same FROM (
              SELECT doc_id, pos // {size} AS b, string_agg(word, ' ' ORDER BY pos) AS block, count(*) AS k FROM v_word GROUP BY doc_id, pos // {size}))
          WHERE same) GROUP BY doc_id, island HAVING count(*) >= 7"""
        for size in (1, 2, 3)
    )
    return (
        ("v_words", f"SELECT doc_id, {S.words(S.collapse('text'))} AS w FROM {texts}"),
        ("v_word", "SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM v_words"),
        ("v_counts", "SELECT doc_id, word, count(*) AS k, min(pos) AS first FROM v_word GROUP BY doc_id, word"),
        ("v_top", """SELECT doc_id, k AS top_n, word AS top_word FROM v_counts
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, first) = 1"""),
        ("v_loop", f"SELECT doc_id, min(size) AS size FROM ({loops}) GROUP BY doc_id"),
        ("v_degenerate", """SELECT w.doc_id, CASE WHEN len(w) < 12 THEN NULL WHEN top_n / CAST(len(w) AS DOUBLE) > 0.35
            THEN 'token ''' || top_word || ''' is ' || CAST(round(top_n * 100 / CAST(len(w) AS DOUBLE)) AS INT) || '% of the output'
            WHEN size IS NOT NULL THEN size || '-word phrase repeats 8+ times' END AS reason
            FROM v_words w LEFT JOIN v_top t ON t.doc_id = w.doc_id LEFT JOIN v_loop l ON l.doc_id = w.doc_id"""),
    )


@query(
    "b8_flag_degenerate",
    with_views(
        "SELECT doc_id, reason IS NOT NULL AS degenerate, reason AS degenerate_reason FROM v_degenerate",
        *degenerate_views("documents"),
    ),
)
def b8(c):
    return T.flag_degenerate(c.documents.select("doc_id", "text"), "text").select(
        "doc_id", "degenerate", "degenerate_reason"
    )


@query(
    "b9_content_words",
    with_views(f"""
    SELECT doc_id, len(words) AS n_words, array_to_string(list_sort(words), ' ') AS words
    FROM (SELECT doc_id, {S.content_words(S.matching('text'))} AS words FROM v_scripted)"""),
)
def b9(c):
    words = T.content_words(F.col("m"))
    return (
        c.scripted.select("doc_id", T.matching_form("text").alias("m"))
        .select("doc_id", words.alias("w"))
        .select("doc_id", F.size("w").alias("n_words"), F.array_join(F.array_sort("w"), " ").alias("words"))
    )


@query(
    "b10_gist",
    with_views(
        """
    SELECT doc_id, CASE WHEN strpos(substr(t, 41), '.') BETWEEN 1 AND 141
        THEN trim(substr(t, 1, 40 + strpos(substr(t, 41), '.')))
      WHEN length(t) > 180 THEN rtrim(substr(t, 1, 180)) || '…' ELSE trim(t) END AS gist
    FROM v_flat""",
        ("v_flat", f"SELECT doc_id, {S.collapse('text')} AS t FROM documents"),
    ),
)
def b10(c):
    return c.documents.select("doc_id", T.gist("text").alias("gist"))


# Driver text quotes with straight quotes and guillemets, so those are its brackets.
_QUOTES = ['"[^"]{4,200}"', "«[^»]{2,200}»"]


@query(
    "b11_opens_discussion",
    f"""SELECT doc_id, regexp_matches(substr({S.collapse('text')}, 1, 160), '{"|".join(_QUOTES)}|Of the|Que la')
        AS opens_discussion FROM documents""",
)
def b11(c):
    return c.documents.select(
        "doc_id",
        T.opens_discussion("text", headers=["Of the", "Que la"], brackets=_QUOTES).alias("opens_discussion"),
    )


_LIMIT = 120


@query(
    "b12_split_sentences",
    with_views(
        f"""
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INT) AS piece, p AS text FROM (
      SELECT doc_id, i, unnest(pieces) AS p, unnest(range(len(pieces))) AS j FROM (
        SELECT doc_id, i, list_transform(CASE WHEN length(s) <= {_LIMIT} THEN [s] ELSE
          string_split(list_reduce(string_split(regexp_replace(s, '([,،؛]) ', '\\1' || chr(2), 'g'), chr(2)),
            lambda acc, x: CASE WHEN length(regexp_extract(acc, '[^' || chr(1) || ']*$')) + length(x) + 1 > {_LIMIT}
              THEN acc || chr(1) || x ELSE acc || ' ' || x END), chr(1)) END, lambda p: trim(p)) AS pieces
        FROM v_sentences WHERE s <> ''))""",
        ("v_sentences", f"""SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM (
            SELECT doc_id, list_transform(string_split(regexp_replace({S.collapse('text')}, '([.؟!۔:]) ', '\\1' || chr(2), 'g'),
              chr(2)), lambda s: trim(s)) AS ss FROM documents)"""),
    ),
)
def b12(c):
    return T.unnest(c.documents, ["doc_id"], T.split_sentences("text", limit=_LIMIT), "text", "piece")


@query(
    "b13_arabic_fragments",
    with_views(f"""
    SELECT doc_id, len(f) AS n_fragments, array_to_string(f, '|') AS fragments FROM (
      SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[\\x{{0600}}-\\x{{06ff}}{S.WS}]{{3,}}'),
        lambda x: {S.strip('x')}), lambda x: x <> '') AS f FROM v_scripted)"""),
)
def b13(c):
    return c.scripted.select("doc_id", T.arabic_fragments("text").alias("f")).select(
        "doc_id", F.size("f").alias("n_fragments"), F.array_join("f", "|").alias("fragments")
    )


@query(
    "b14_historical_period",
    with_views("""
    SELECT d.doc_id, w.work_slug, CASE WHEN w.death_year IS NULL THEN 'UNKNOWN' WHEN w.death_year <= 150 THEN 'FORMATIVE'
      WHEN w.death_year <= 400 THEN 'EARLY' WHEN w.death_year <= 700 THEN 'CLASSICAL'
      WHEN w.death_year <= 1000 THEN 'MEDIEVAL' WHEN w.death_year <= 1300 THEN 'LATER' ELSE 'MODERN' END AS period
    FROM documents d JOIN v_work w ON w.work_slug = d.source"""),
)
def b14(c):
    return c.documents.select("doc_id", F.col("source").alias("work_slug")).join(
        c.works.select("work_slug", "death_year"), "work_slug"
    ).select("doc_id", "work_slug", T.historical_period("death_year").alias("period"))


# The fold is a running string: chr(1) closes a pack.
def _packed(list_sql: str, limit: int, joiner: str) -> str:
    return (
        f"string_split(list_reduce({list_sql}, lambda acc, x: CASE WHEN "
        f"length(regexp_extract(acc, '[^' || chr(1) || ']*$')) + length(x) + {len(joiner)} > {limit} "
        f"THEN acc || chr(1) || x ELSE acc || '{joiner}' || x END), chr(1))"
    )


def chunk_views(texts: str) -> tuple[tuple[str, str], ...]:
    """Oracle views over `texts` (doc_id, text): v_chunk(doc_id, chunk_index, raw_text).

    Driver text has no blank lines and no headers: a document is one unit.
    """
    return (
        ("v_unit", f"SELECT doc_id, {S.strip('text')} AS unit FROM {texts}"),
        ("v_pieces", f"""SELECT doc_id, CASE WHEN length(unit) <= 2200 THEN [unit] ELSE
            {_packed(f"list_filter(string_split(regexp_replace(unit, '([.؟!۔])[{S.WS}]+', chr(92) || '1' || chr(2), 'g'), chr(2)), lambda s: {S.strip('s')} <> '')", 1200, ' ')}
            END AS pieces FROM v_unit WHERE unit <> ''"""),
        ("v_chunks", f"""SELECT doc_id, {_packed(f"list_transform(pieces, lambda p: {S.strip('p')})", 1200, chr(10) * 2)} AS chunks
            FROM v_pieces"""),
        ("v_chunk", """SELECT doc_id, i AS chunk_index, chunk AS raw_text FROM (
          SELECT doc_id, unnest(folded) AS chunk, unnest(range(len(folded))) AS i FROM (
            SELECT doc_id, CASE WHEN len(chunks) > 1 AND length(chunks[len(chunks)]) < 120
              THEN list_concat(chunks[1:len(chunks) - 2], [chunks[len(chunks) - 1] || chr(10) || chr(10) || chunks[len(chunks)]])
              ELSE chunks END AS folded FROM v_chunks))"""),
    )


@query(
    "c1_chunk_documents",
    with_views(
        f"""SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, raw_text, {S.matching('raw_text')} AS matching,
          {S.display('raw_text')} AS display, CAST(length(raw_text) AS INT) AS char_count FROM v_chunk""",
        *chunk_views("documents"),
    ),
)
def c1(c):
    return chunk_documents(c.documents, "text").select(
        "doc_id", "chunk_index", "raw_text", "matching", "display", "char_count"
    )
