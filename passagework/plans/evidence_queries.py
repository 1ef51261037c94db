"""Registered queries: evidence assembly (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.operators import evidence as E
from passagework.operators import references as R
from passagework.operators import retrieval as Q
from passagework.operators import understanding as U
from passagework.operators.tables import bounded
from passagework.plans import sql_text as S
from passagework.plans.answer import Corpus, Vocabulary, answer_queries
from passagework.plans.driver_views import with_views
from passagework.plans.registry import query
from passagework.plans.retrieval_queries import (
    BM25, DRIVER_COMMENTARY, DRIVER_KEYWORDS, FUSION_VIEWS, OVERLAP, TOKEN_VIEWS,
    chapters, injected, spread_sql, two_lists,
)
from passagework.functions import vocab as V
from passagework.session import materialise

# --------------------------------------------------------------------------
# Works with names; results of the structural and lexical lists
# --------------------------------------------------------------------------

_NAMED_WORK = """
    SELECT work_slug, n, death_year, catalogue_rank, 'مصنف ' || n AS title_ar,
      CASE WHEN n % 4 <> 1 THEN 'Work ' || n END AS title_en,
      CASE WHEN n % 5 <> 0 THEN 'مؤلف ' || n END AS author_ar, CASE WHEN n % 3 <> 1 THEN 'Author ' || n END AS author_en FROM v_work"""


def named_works(c):
    n = F.col("n").cast("string")
    return bounded(
        c.works.select(
            "work_slug", "n", "death_year",
            F.concat(F.lit("مصنف "), n).alias("title_ar"),
            F.when(F.col("n") % 4 != 1, F.concat(F.lit("Work "), n)).alias("title_en"),
            F.when(F.col("n") % 5 != 0, F.concat(F.lit("مؤلف "), n)).alias("author_ar"),
            F.when(F.col("n") % 3 != 1, F.concat(F.lit("Author "), n)).alias("author_en"),
        )
    )


RESULT_VIEWS = (
    *FUSION_VIEWS, ("v_named", _NAMED_WORK), ("v_kept", spread_sql("v_fused", 3, 12)),
    ("v_result", """SELECT k.query_id, k.position, k.fused_score, p.passage_id, p.work_slug, p.language, p.verification_status, p.volume, p.page_start,
          w.title_ar, w.title_en, coalesce(w.author_ar, '—') AS author_ar, w.author_en, w.death_year
        FROM v_kept k JOIN v_published p ON p.passage_id = k.passage_id JOIN v_named w ON w.work_slug = p.work_slug"""),
    ("v_cited", f"""SELECT *, volume IS NOT NULL AND page_start IS NOT NULL AS paged,
          coalesce(author_en, author_ar) || ', ' || coalesce(title_en, title_ar) || coalesce(', vol. ' || volume, '') || coalesce(', p. ' || page_start, '')
            || CASE WHEN volume IS NULL OR page_start IS NULL THEN ', {E.NO_PAGE}' ELSE '' END AS citation FROM v_result"""),
    ("v_result_work", """SELECT query_id, work_slug, min(position) AS first_position, count(*) AS passages_cited, max(death_year) AS death_year,
          bool_or(paged) AS resolves_to_page FROM v_cited GROUP BY query_id, work_slug"""),
)


def oracle(body: str) -> str:
    return with_views(body, *RESULT_VIEWS)


def results(c):
    kept = materialise(Q.hybrid_search(two_lists(c), c.unnumbered_published, limit=12))
    return E.cite(kept.join(c.unnumbered_published.drop("work_slug"), "passage_id"), named_works(c))


@query(
    "e1_cite",
    with_views(
        f"""SELECT p.passage_id, p.work_slug, title_ar, title_en, coalesce(author_ar, '—') AS author_ar, author_en, death_year, p.volume, p.page_start,
          md5(p.raw_text) AS display_text FROM v_published p JOIN v_named w ON w.work_slug = p.work_slug""",
        ("v_named", _NAMED_WORK),
    ),
)
def e1(c):
    return E.cite(c.published, named_works(c)).select(
        "passage_id", "work_slug", "title_ar", "title_en", "author_ar", "author_en", "death_year", "volume", "page_start",
        F.md5("display_text").alias("display_text"),
    )


EDITION_SQL = """
    SELECT s_suppkey AS edition, s_name AS edition_publisher, 1900 + s_nationkey AS edition_year,
      CASE WHEN s_acctbal < 0 THEN 'HUMAN_REVIEW' ELSE 'PUBLISHED' END AS corpus_state FROM supplier"""


def editions(c):
    return c.table("supplier").select(
        F.col("s_suppkey").alias("edition"), F.col("s_name").alias("edition_publisher"), (1900 + F.col("s_nationkey")).alias("edition_year"),
        F.when(F.col("s_acctbal") < 0, "HUMAN_REVIEW").otherwise("PUBLISHED").alias("corpus_state"),
    )


def in_editions(passages):
    """Every passage belongs to one of ten editions; every fourth was read from a scanned page."""
    p = F.col("passage_id")
    return passages.withColumns({"edition": p % 10, "scan_page_id": F.when(p % 4 == 0, F.floor(p / 4))})


@query(
    "e1_full_citation",
    with_views(
        """SELECT p.passage_id, p.work_slug, coalesce(author_ar, '—') AS author_ar, edition_publisher, edition_year, g.url AS scan_page_uri,
          a.chapter, a.verse_start, a.verse_end, round((p.passage_id % 100) / CAST(100 AS DOUBLE), 2) AS alignment_confidence
        FROM v_published p JOIN v_named w ON w.work_slug = p.work_slug JOIN v_edition e ON e.edition = p.passage_id % 10
        JOIN v_passage_verse a ON a.passage_id = p.passage_id LEFT JOIN pages g ON p.passage_id % 4 = 0 AND g.page_id = p.passage_id // 4""",
        ("v_named", _NAMED_WORK), ("v_edition", EDITION_SQL),
    ),
)
def e1_full(c):
    pages = c.table("pages").select(F.col("page_id").alias("scan_page_id"), F.col("url").alias("scan_page_uri"))
    # A second, later alignment of each passage is not the one that is cited.
    placed = c.alignments.withColumn("confidence", F.round((F.col("passage_id") % 100) / F.lit(100.0), 2))
    later = placed.withColumns({"chapter": F.col("chapter") + 10, "confidence": F.lit(0.0)})
    return E.cite(
        in_editions(c.published), named_works(c), editions=editions(c).drop("corpus_state"), scan_pages=pages, alignments=placed.unionByName(later)
    ).select(
        "passage_id", "work_slug", "author_ar", "edition_publisher", "edition_year", "scan_page_uri", "chapter", "verse_start", "verse_end", "alignment_confidence"
    )


@query("e2_citation_string", oracle("SELECT query_id, passage_id, citation, paged AS resolves_to_page FROM v_cited"))
def e2(c):
    return results(c).select(
        "query_id", "passage_id", E.citation_string("en", page_end=False).alias("citation"),
        E.resolves_to_page().alias("resolves_to_page"),
    )


@query(
    "e3_works_of_results",
    oracle("""SELECT query_id, work_slug, first_position, passages_cited, death_year, resolves_to_page,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY death_year NULLS LAST, first_position) AS INT) AS number FROM v_result_work"""),
)
def e3(c):
    return E.works_of(results(c), chronological=True)


@query(
    "e4_verification_histogram",
    oracle("""SELECT query_id, work_slug, string_agg(verification_status || '=' || n, ',' ORDER BY verification_status) AS statuses
        FROM (SELECT query_id, work_slug, verification_status, count(*) AS n FROM v_result GROUP BY ALL) GROUP BY query_id, work_slug"""),
)
def e4(c):
    entries = F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return E.verification_histogram(results(c)).select(
        "query_id", "work_slug", F.array_join(F.array_sort(entries), ",").alias("statuses")
    )


_PACKAGE = """
    SELECT q.query_id, count(r.passage_id) AS passage_count, count(DISTINCT r.work_slug) AS work_count,
      count(*) FILTER (WHERE r.verification_status <> 'VERIFIED') AS unverified_count, count(r.passage_id) = 0 AS is_empty,
      coalesce(round(count(*) FILTER (WHERE r.paged) / CAST(nullif(count(r.passage_id), 0) AS DOUBLE), 6), 0) AS page_coverage,
      coalesce(round(count(*) FILTER (WHERE t.passage_id IS NOT NULL) / CAST(nullif(count(r.passage_id), 0) AS DOUBLE), 6), 0) AS translation_coverage
    FROM v_query q LEFT JOIN v_cited r ON r.query_id = q.query_id
    LEFT JOIN (SELECT DISTINCT passage_id FROM v_translation) t ON t.passage_id = r.passage_id GROUP BY q.query_id"""


def packages(c):
    r = results(c)
    done = r.select("query_id", "passage_id").join(c.translations.select("passage_id"), "passage_id", "left_semi")
    return E.evidence_packages(c.queries, r, done)


@query("e5_evidence_packages", oracle(_PACKAGE))
def e5(c):
    return packages(c).drop("citable_ids")


@query(
    "e6_package_notes",
    with_views(
        f"""SELECT query_id, concat_ws('|', CASE WHEN is_empty THEN '{E.NOTE_EMPTY}' END,
          CASE WHEN NOT is_empty AND page_coverage = 0 THEN '{E.NOTE_NO_PAGE}' END,
          CASE WHEN page_coverage > 0 AND page_coverage < 1 THEN CAST(round(page_coverage * 100) AS INT) || '% of retrieved passages carry a page-level citation.' END,
          CASE WHEN unverified_count > 0 THEN unverified_count || ' of ' || passage_count || ' passages have not been verified against a page image by a human reviewer.' END) AS notes
        FROM v_package""",
        *RESULT_VIEWS, ("v_package", _PACKAGE),
    ),
)
def e6(c):
    return packages(c).select("query_id", F.array_join(E.package_notes(), "|").alias("notes"))


@query(
    "e7_verse_texts",
    with_views("""
    SELECT query_id, chapter, verse, verse_text, coalesce(string_agg(slug || '=' || text, '|' ORDER BY slug), '') AS translations FROM (
      SELECT DISTINCT r.query_id, v.chapter, v.verse, v.text AS verse_text FROM v_query_ref r JOIN v_verse v ON v.chapter = r.chapter
        AND v.verse BETWEEN r.verse_start AND r.verse_end) w
    LEFT JOIN (SELECT 't' || item_id % 2 AS slug, chapter AS c, verse AS v, lower(text) AS text FROM v_verse WHERE item_id % 3 <> 0) t
      ON t.c = w.chapter AND t.v = w.verse GROUP BY query_id, chapter, verse, verse_text"""),
)
def e7(c):
    i = F.col("item_id")
    translations = c.verses.select(
        F.concat(F.lit("t"), (i % 2).cast("string")).alias("slug"), "chapter", "verse", F.lower("text").alias("text"),
        F.when(i % 3 != 0, "en").otherwise("ar").alias("language"),
    )
    out = E.verse_texts(c.query_refs, c.verses, translations)
    shown = F.transform("translations", lambda t: F.concat(t["slug"], F.lit("="), t["text"]))
    return out.select("query_id", "chapter", "verse", "verse_text", F.array_join(shown, "|").alias("translations"))


@query(
    "e8_best_translations",
    with_views("""SELECT passage_id, language, text, translator_kind, translator_name, verification_status FROM v_translation
        QUALIFY row_number() OVER (PARTITION BY passage_id, language ORDER BY CASE translator_kind WHEN 'HUMAN' THEN 0 ELSE 1 END,
          CASE verification_status WHEN 'VERIFIED' THEN 0 ELSE 1 END, translator_name, text) = 1"""),
)
def e8(c):
    return E.best_translations(c.translations)


@query(
    "e9_reference_list",
    oracle("""SELECT w.query_id, CAST(row_number() OVER (PARTITION BY w.query_id ORDER BY first_position) AS INT) AS number, w.work_slug, passages_cited,
        w.resolves_to_page, w.death_year IS NOT NULL AS dates_known, c.citation AS full_citation
        FROM v_result_work w JOIN v_cited c ON c.query_id = w.query_id AND c.position = w.first_position"""),
)
def e9(c):
    r = results(c)
    return E.reference_list(r, E.works_of(r))


@query(
    "e9_edition_references",
    with_views(
        """SELECT w.query_id, CAST(row_number() OVER (PARTITION BY w.query_id ORDER BY first_position) AS INT) AS number, w.work_slug, passages_cited,
        w.resolves_to_page, w.death_year IS NOT NULL AS dates_known, c.citation AS full_citation, edition_publisher, edition_year
        FROM v_result_work w JOIN v_cited c ON c.query_id = w.query_id AND c.position = w.first_position JOIN v_edition e ON e.edition = c.passage_id % 10""",
        *RESULT_VIEWS, ("v_edition", EDITION_SQL),
    ),
)
def e9_editions(c):
    r = results(c)
    cited = in_editions(r).join(editions(c).drop("corpus_state"), "edition")
    return E.reference_list(cited, E.works_of(r), facts=["edition_publisher", "edition_year"])


@query(
    "e10_untranslated",
    oracle("""SELECT query_id, passage_id FROM v_result r WHERE language <> 'en'
        AND NOT EXISTS (SELECT 1 FROM v_translation t WHERE t.passage_id = r.passage_id)"""),
)
def e10(c):
    return E.untranslated(results(c), c.translations, wanted="en")


_TYPES = "['AYAH_TAFSIR', 'COMPARATIVE', 'HISTORICAL', 'UNKNOWN']"


@query(
    "e11_log_rules",
    f"""SELECT event_id AS run_id, rule_key, 'retrieval' AS stage FROM events e JOIN (VALUES {", ".join(
        f"('{k}', CAST([{S.quoted(types)}] AS VARCHAR[]))" for k, _, _, types, _ in V.BASELINE_RULES)}) r(rule_key, applies)
      ON len(r.applies) = 0 OR list_contains(r.applies, {_TYPES}[1 + e.user_id % 4])""",
)
def e11(c):
    types = F.element_at(F.lit(["AYAH_TAFSIR", "COMPARATIVE", "HISTORICAL", "UNKNOWN"]), (1 + F.col("user_id") % 4).cast("int"))
    runs = c.table("events").select(F.col("event_id").alias("run_id"), types.alias("classified_type"))
    wanted = runs.select(F.col("classified_type").alias("query_type"))
    return E.log_rules(runs, U.rules_for_types(wanted, U.baseline_rules(c.spark)))


# --------------------------------------------------------------------------
# Flagship
# --------------------------------------------------------------------------

# Terms of the invented languages and the corpus words they stand for.
FLAGSHIP_LEXICON = {
    "thing": "from", "that": "this", "with": "for", "dans": "pour", "que la": "une", "und": "das", "los": "para",
}
FLAGSHIP_VOCABULARY = Vocabulary(
    lexicons={"en": FLAGSHIP_LEXICON}, keywords=DRIVER_KEYWORDS, commentary_terms=DRIVER_COMMENTARY
)


def flagship_corpus(c) -> Corpus:
    # Every canonical item gives the work of its number, modulo 20, a name: its first long word.
    named = c.works.join(
        c.table("benchmark").select((F.col("item_id") % 20).alias("n"), F.regexp_extract("text", "[A-Za-z]{6,}", 0).alias("word")), "n"
    )
    terms = (
        named.select(F.lower("word").alias("term"), "work_slug").filter(F.length("term") >= 4)
        .groupBy("term").agg(F.min("work_slug").alias("work_slug"))
    )
    return Corpus(
        published=c.published, index=c.index, alignments=c.alignments, works=named_works(c),
        work_terms=bounded(terms), chapters=R.chapter_index(chapters(c)), rules=U.baseline_rules(c.spark),
        verses=c.verses, translations=c.translations,
    )


def _carried() -> tuple[list[tuple[str, str]], str]:
    ordered = sorted(FLAGSHIP_LEXICON, key=len, reverse=True)
    views = [("p0", "SELECT query_id, lower(text) AS rest, CAST([] AS VARCHAR[]) AS pieces FROM v_turn")]
    for i, t in enumerate(ordered):
        v = FLAGSHIP_LEXICON[t]
        views.append(
            (f"p{i + 1}", f"""SELECT query_id, replace(rest, '{t}', ' ') AS rest, CASE WHEN contains(rest, '{t}') AND NOT list_contains(pieces, '{v}')
              THEN list_append(pieces, '{v}') ELSE pieces END AS pieces FROM p{i}""")
        )
    return views, f"p{len(ordered)}"


_CARRIED, _LAST = _carried()
_HIT_VALUES = ", ".join(
    f"('{t}', '{k}', {'true' if k.isascii() else 'false'}, {V.KEYWORD_PRIORITY.index(t) if t in V.KEYWORD_PRIORITY else 99})"
    for t, ks in DRIVER_KEYWORDS.items() for k in ks
)
FLAGSHIP_VIEWS = (
    *TOKEN_VIEWS,
    ("v_turn", """SELECT q.query_id, q.text AS plain, q.text || ' ' || CASE q.query_id % 3 WHEN 0 THEN r.chapter || ':' || r.verse_start || '-' || r.verse_end
        WHEN 1 THEN 'chapter ' || r.chapter || ', verse ' || r.verse_start || '-' || r.verse_end
        ELSE replace(g.r_name, ' ', '') || ' ' || r.verse_start || '-' || r.verse_end END AS text
        FROM v_query q JOIN v_query_ref r ON r.query_id = q.query_id JOIN region g ON g.r_regionkey + 1 = r.chapter"""),
    *_CARRIED,
    ("v_term", """SELECT lower(word) AS term, min(work_slug) AS work_slug FROM (SELECT regexp_extract(b.text, '[A-Za-z]{6,}') AS word, w.work_slug
        FROM v_work w JOIN benchmark b ON b.item_id % 20 = w.n) WHERE length(word) >= 4 GROUP BY 1"""),
    ("v_works_named", """SELECT t.query_id, list(DISTINCT w.work_slug) AS works FROM v_turn t JOIN v_term w ON contains(lower(t.text), w.term) GROUP BY t.query_id"""),
    ("v_keyword_hit", f"""SELECT t.query_id, k.type, k.pos FROM v_turn t JOIN (VALUES {_HIT_VALUES}) k(type, term, ascii, pos)
        ON contains(CASE WHEN k.ascii THEN lower(t.text) ELSE {S.key('t.text')} END, k.term)"""),
    ("v_typed", f"""SELECT t.query_id, t.plain, n.works, p.pieces, CASE WHEN coalesce(len(n.works), 0) >= 2
          OR EXISTS (SELECT 1 FROM v_keyword_hit h WHERE h.query_id = t.query_id AND h.type = 'COMPARATIVE') THEN 'COMPARATIVE'
        ELSE coalesce((SELECT arg_min(type, pos) FROM v_keyword_hit h WHERE h.query_id = t.query_id AND pos < 99),
          CASE WHEN n.works IS NOT NULL THEN 'MUFASSIR_SPECIFIC' ELSE 'AYAH_TAFSIR' END) END AS query_type
        FROM v_turn t LEFT JOIN v_works_named n ON n.query_id = t.query_id JOIN {_LAST} p ON p.query_id = t.query_id"""),
    ("v_item", f"""SELECT query_id, unnest(items) AS item, unnest(range(len(items))) AS pos FROM (SELECT query_id, string_split(
        {S.matching("CASE WHEN len(pieces) > 0 THEN array_to_string(pieces, ' ') ELSE " + S.collapse('plain') + " END")}, ' ') AS items FROM v_typed)"""),
    ("v_branched", "SELECT *, count(*) FILTER (WHERE lower(item) = 'or') OVER (PARTITION BY query_id ORDER BY pos) AS branch FROM v_item"),
    ("v_branch_term", f"""SELECT DISTINCT query_id, branch, unnest({S.tokens('item')}) AS term FROM v_branched
        WHERE lower(item) <> 'or' AND NOT starts_with(item, '-')"""),
    ("v_wanted", "SELECT DISTINCT query_id, term FROM v_branch_term"),
    ("v_found", """SELECT DISTINCT b.query_id, p.passage_id FROM (SELECT b.query_id, b.branch, p.passage_id, count(*) AS n FROM v_branch_term b
          JOIN v_tf p ON p.term = b.term GROUP BY ALL) p JOIN (SELECT query_id, branch, count(*) AS n FROM v_branch_term GROUP BY ALL) b
        ON b.query_id = p.query_id AND b.branch = p.branch AND b.n = p.n"""),
    ("v_allowed", f"""SELECT f.* FROM v_found f JOIN v_typed t ON t.query_id = f.query_id JOIN v_tok d ON d.passage_id = f.passage_id
        WHERE (t.works IS NULL OR list_contains(t.works, d.work_slug)) AND EXISTS (SELECT 1 FROM v_query_ref r JOIN v_passage_verse a ON {OVERLAP}
          WHERE r.query_id = f.query_id AND a.passage_id = f.passage_id)"""),
    ("v_scored", f"""SELECT w.query_id, p.passage_id, round({BM25}, 6) AS score FROM v_allowed x JOIN v_wanted w ON w.query_id = x.query_id
        JOIN v_df f ON f.term = w.term JOIN v_tf p ON p.term = w.term AND p.passage_id = x.passage_id
        JOIN v_tok d ON d.passage_id = p.passage_id, v_stats s GROUP BY w.query_id, p.passage_id"""),
    ("v_sparse", """SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM v_scored
        QUALIFY rank <= 100"""),
    ("v_structural", f"""SELECT query_id, passage_id, work_slug, row_number() OVER (PARTITION BY query_id ORDER BY work_rank, work_slug, passage_id) AS rank
        FROM (SELECT r.query_id, p.passage_id, p.work_slug, row_number() OVER (PARTITION BY r.query_id, p.work_slug
            ORDER BY a.chapter, a.verse_start, p.sequence_index, p.passage_id) AS work_rank
          FROM v_query_ref r JOIN v_passage_verse a ON {OVERLAP} JOIN v_published p ON p.passage_id = a.passage_id
          JOIN v_typed t ON t.query_id = r.query_id WHERE t.works IS NULL OR list_contains(t.works, p.work_slug) QUALIFY work_rank <= 6) QUALIFY rank <= 200"""),
    ("v_fused", """SELECT query_id, passage_id, round(sum(w / (60 + rank)), 9) AS fused_score FROM (SELECT query_id, passage_id, rank, 1.5 AS w FROM v_structural
        UNION ALL SELECT query_id, passage_id, rank, 1.0 FROM v_sparse) GROUP BY query_id, passage_id"""),
    ("v_kept", spread_sql("v_fused", 3, 12)),
    ("v_order", """SELECT k.query_id, k.work_slug, row_number() OVER (PARTITION BY k.query_id ORDER BY CASE WHEN any_value(t.query_type) = 'HISTORICAL'
          THEN any_value(w.death_year) END NULLS LAST, min(k.position)) AS number
        FROM v_kept k JOIN v_typed t ON t.query_id = k.query_id JOIN v_work w ON w.work_slug = k.work_slug GROUP BY k.query_id, k.work_slug"""),
)


@query(
    "e12_answer_queries",
    with_views(
        """SELECT k.query_id, k.position, k.passage_id, k.work_slug, k.fused_score, t.query_type, CAST(o.number AS INT) AS reference_number
        FROM v_kept k JOIN v_typed t ON t.query_id = k.query_id JOIN v_order o ON o.query_id = k.query_id AND o.work_slug = k.work_slug""",
        *FLAGSHIP_VIEWS,
    ),
)
def e12(c):
    answer = answer_queries(injected(c), flagship_corpus(c), vocabulary=FLAGSHIP_VOCABULARY)
    return answer["passages"].join(answer["understood"].select("query_id", "query_type"), "query_id").select(
        "query_id", "position", "passage_id", "work_slug", "fused_score", "query_type", "reference_number"
    )


@query(
    "e12_answer_packages",
    with_views(
        """SELECT t.query_id, t.query_type, count(k.passage_id) AS passage_count, count(DISTINCT k.work_slug) AS work_count,
          count(k.passage_id) = 0 AS is_empty FROM v_typed t LEFT JOIN v_kept k ON k.query_id = t.query_id GROUP BY t.query_id, t.query_type""",
        *FLAGSHIP_VIEWS,
    ),
)
def e12_packages(c):
    answer = answer_queries(injected(c), flagship_corpus(c), vocabulary=FLAGSHIP_VOCABULARY)
    return answer["package"].select("query_id", "query_type", "passage_count", "work_count", "is_empty")


def _answer(c, **given):
    asked = injected(c)
    for name, value in given.items():
        asked = asked.withColumn(name, F.lit(value))
    return answer_queries(asked, flagship_corpus(c), vocabulary=FLAGSHIP_VOCABULARY)


@query(
    "e11_log_runs",
    with_views(
        """SELECT t.query_id AS run_id, q.text AS raw_query, t.query_type AS classified_type, CAST(count(k.passage_id) AS BIGINT) AS evidence_count,
          '["' || r.chapter || ':' || r.verse_start || CASE WHEN r.verse_end > r.verse_start THEN '-' || r.verse_end ELSE '' END || '"]' AS resolved_refs
        FROM v_typed t JOIN v_turn q ON q.query_id = t.query_id JOIN v_query_ref r ON r.query_id = t.query_id
        LEFT JOIN v_kept k ON k.query_id = t.query_id
        GROUP BY t.query_id, q.text, t.query_type, r.chapter, r.verse_start, r.verse_end""",
        *FLAGSHIP_VIEWS,
    ),
)
def e11_runs(c):
    return _answer(c)["runs"].select("run_id", "raw_query", "classified_type", "evidence_count", "resolved_refs")


@query(
    "e12_untranslated",
    with_views(
        """SELECT k.query_id, k.passage_id FROM v_kept k JOIN v_published p ON p.passage_id = k.passage_id WHERE p.language <> 'en'
          AND NOT EXISTS (SELECT 1 FROM v_translation t WHERE t.passage_id = k.passage_id AND t.language = 'en')""",
        *FLAGSHIP_VIEWS,
    ),
)
def e12_untranslated(c):
    return _answer(c, user_language="en")["untranslated"]
