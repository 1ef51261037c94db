"""Registered queries: table maintenance (A), reports (I), data quality (J), evaluation (L)."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions import vocab as V
from passagework.operators import evaluation as L
from passagework.operators import inference as K
from passagework.operators import quality as J
from passagework.operators import reports as P
from passagework.operators import retrieval as Q
from passagework.operators import tables as A
from passagework.plans import sql_text as S
from passagework.plans.driver_views import with_views
from passagework.plans.registry import query
from passagework.plans.retrieval_queries import _RULES, chapters, driver_rules
from passagework.plans.text_queries import chunk_views, degenerate_views
from passagework.session import materialise, shared_folder
from passagework.sources import commentary as X

# --------------------------------------------------------------------------
# A: sources and table maintenance
# --------------------------------------------------------------------------

_ENTRIES = """
    SELECT doc_id AS entry_id, source AS work_slug, doc_id % 6 AS chapter, CAST(floor(doc_id / 6) AS BIGINT) % 12 AS verse,
      CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE text END AS text FROM documents"""


def entries(c):
    d = F.col("doc_id")
    return c.documents.select(
        d.alias("entry_id"), F.col("source").alias("work_slug"), (d % 6).alias("chapter"),
        (F.floor(d / 6) % 12).alias("verse"), F.when(d % 11 == 0, "  ").otherwise(F.col("text")).alias("text"),
    )


#: The chunks of the valid entries, numbered per work.
_INGEST = (
    ("v_entry", _ENTRIES),
    ("v_valid", f"SELECT entry_id AS doc_id, work_slug, chapter, verse, text FROM v_entry WHERE {S.strip('text')} <> '' AND chapter BETWEEN 1 AND 5 AND verse BETWEEN 1 AND 8"),
    *chunk_views("v_valid"),
    ("v_numbered", """SELECT e.work_slug, e.chapter, e.verse, CAST(length(k.raw_text) AS INT) AS char_count,
        row_number() OVER (PARTITION BY e.work_slug ORDER BY e.chapter, e.verse, e.doc_id, k.chunk_index) - 1 AS sequence_index
        FROM v_chunk k JOIN v_valid e ON e.doc_id = k.doc_id"""),
)


def small_chapters(c):
    return A.bounded(chapters(c).select("number", "verse_count"))


@query(
    "a3_validate_entries",
    with_views(
        f"""SELECT work_slug, count(*) FILTER (WHERE {S.strip('text')} <> '' AND chapter BETWEEN 1 AND 5 AND verse BETWEEN 1 AND 8) AS kept,
          count(*) FILTER (WHERE {S.strip('text')} = '') AS skipped_blank,
          count(*) FILTER (WHERE {S.strip('text')} <> '' AND NOT (chapter BETWEEN 1 AND 5 AND verse BETWEEN 1 AND 8)) AS skipped_place
        FROM v_entry GROUP BY work_slug""",
        ("v_entry", _ENTRIES),
    ),
)
def a3(c):
    return X.entry_report(X.check_entries(entries(c), small_chapters(c)))


@query(
    "a4_ingest_report",
    with_views(
        f"""SELECT work_slug, count(*) FILTER (WHERE ok) AS verses_covered, count(DISTINCT chapter * 100 + verse) FILTER (WHERE ok) AS distinct_verses,
          count(*) FILTER (WHERE {S.strip('text')} = '') AS skipped_empty,
          (SELECT count(*) FROM v_numbered n WHERE n.work_slug = e.work_slug) AS passages_written
        FROM (SELECT *, {S.strip('text')} <> '' AND chapter BETWEEN 1 AND 5 AND verse BETWEEN 1 AND 8 AS ok FROM v_entry) e GROUP BY work_slug""",
        *_INGEST,
    ),
)
def a4(c):
    report = X.ingest(entries(c), small_chapters(c))[2]
    return report.select("work_slug", "verses_covered", "distinct_verses", "skipped_empty", "passages_written")


@query(
    "a4_ingest_passages",
    with_views(
        """SELECT sha256(work_slug || '|' || sequence_index) AS passage_id, work_slug, sequence_index, chapter, verse, char_count
        FROM v_numbered""",
        *_INGEST,
    ),
)
def a4_passages(c):
    return X.ingest(entries(c), small_chapters(c))[0].select(
        "passage_id", "work_slug", "sequence_index", "chapter", "verse", "char_count"
    )


@query(
    "a5_sequence_index",
    with_views("SELECT passage_id, work_slug, sequence_index FROM v_passage"),
)
def a5(c):
    d = c.table("documents").select(F.col("doc_id").alias("passage_id"), F.col("source").alias("work_slug"))
    return A.number_within(d, ["work_slug"], ["passage_id"], A.id_bucket("passage_id")).select(
        "passage_id", "work_slug", "sequence_index"
    )


@query(
    "a6_upsert_authors",
    """SELECT coalesce(o.slug, n.slug) AS slug, coalesce(o.name_ar, n.name_ar) AS name_ar, CASE WHEN n.slug IS NOT NULL THEN n.name_en ELSE o.name_en END AS name_en,
      CAST(coalesce(o.death_year, n.death_year) AS BIGINT) AS death_year, CASE WHEN n.slug IS NOT NULL THEN n.period ELSE o.period END AS period
    FROM (SELECT c_custkey AS slug, c_name AS name_ar, c_mktsegment AS name_en, CASE WHEN c_nationkey > 9 THEN c_nationkey END AS death_year,
        'OLD' AS period FROM customer) o
    FULL JOIN (SELECT o_custkey AS slug, 'from orders' AS name_ar, max(o_orderpriority) AS name_en, max(o_orderkey) AS death_year, 'NEW' AS period
      FROM orders GROUP BY o_custkey) n ON n.slug = o.slug""",
)
def a6(c):
    old = c.table("customer").select(
        F.col("c_custkey").alias("slug"), F.col("c_name").alias("name_ar"), F.col("c_mktsegment").alias("name_en"),
        F.when(F.col("c_nationkey") > 9, F.col("c_nationkey")).cast("long").alias("death_year"), F.lit("OLD").alias("period"),
    )
    new = c.table("orders").groupBy(F.col("o_custkey").alias("slug")).agg(
        F.max("o_orderpriority").alias("name_en"), F.max("o_orderkey").alias("death_year")
    ).withColumns({"name_ar": F.lit("from orders"), "period": F.lit("NEW")})
    return A.upsert(old, new, ["slug"], A.AUTHOR_RULES)


@query(
    "a7_replace_groups",
    """SELECT doc_id, source, 'old' AS origin FROM documents WHERE source NOT IN (SELECT source FROM documents GROUP BY source HAVING min(doc_id) % 2 = 0)
    UNION ALL SELECT doc_id + 1000000, source, 'new' FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING min(doc_id) % 2 = 0)""",
)
def a7(c):
    d = c.table("documents").select("doc_id", "source")
    chosen = d.groupBy("source").agg(F.min("doc_id").alias("m")).filter("m % 2 = 0").select("source")
    fresh = d.join(chosen, "source", "left_semi").select(
        (F.col("doc_id") + 1_000_000).alias("doc_id"), "source", F.lit("new").alias("origin")
    )
    return A.replace_groups(d.withColumn("origin", F.lit("old")), fresh, ["source"])


@query(
    "a8_upsert_verses",
    """SELECT chapter, verse, max_by(text, item_id) AS text FROM (SELECT item_id, item_id % 5 AS chapter, item_id % 9 AS verse, text FROM benchmark)
    GROUP BY chapter, verse""",
)
def a8(c):
    i = F.col("item_id")
    rows = c.table("benchmark").select("item_id", (i % 5).alias("chapter"), (i % 9).alias("verse"), "text")
    keys = ["chapter", "verse"]
    first = rows.groupBy(*keys).agg(F.min_by("text", "item_id").alias("text"))
    last = rows.groupBy(*keys).agg(F.max_by("text", "item_id").alias("text"))
    return A.upsert(first, last, keys, {"text": "new"})


@query(
    "a11_write_once_ocr",
    with_views("""SELECT p.page_id, CASE WHEN p.page_id % 2 = 0 THEN CASE WHEN coalesce(trim(ocr_raw_text), '') = '' THEN 'read ' || url ELSE ocr_raw_text END
        ELSE ocr_raw_text END AS ocr_raw_text, CASE WHEN p.page_id % 2 = 0 THEN 0.5 ELSE ocr_confidence END AS ocr_confidence, p.page_id % 2 = 0 AS needs_review
        FROM v_scan_page p JOIN pages g ON g.page_id = p.page_id"""),
)
def a11(c):
    pages = c.scan_pages.withColumns({"ocr_normalized_text": F.lit(None).cast("string"), "needs_review": F.lit(False)})
    readings = c.table("pages").filter("page_id % 2 = 0").select(
        "page_id", F.concat(F.lit("read "), "url").alias("text"), F.lit(0.5).alias("confidence")
    )
    return A.write_once_ocr(pages, readings).select("page_id", "ocr_raw_text", "ocr_confidence", "needs_review")


@query(
    "a12_rebuild_pages",
    with_views(
        """SELECT page_id, string_agg(line, chr(10) ORDER BY block, first) AS text, round(sum(c) / (sum(n) * 100), 6) AS confidence FROM (
          SELECT page_id, block, line_no, string_agg(word, ' ' ORDER BY ord) AS line, min(ord) AS first, sum(conf) AS c, count(*) AS n
          FROM v_word WHERE conf >= 0 AND word <> '' GROUP BY page_id, block, line_no) GROUP BY page_id""",
        ("v_word", f"""SELECT doc_id AS page_id, ord, CAST(floor(ord / 100) AS INT) AS block, CAST(floor(ord / 10) AS INT) AS line_no, w[ord + 1] AS word,
            CAST(length(w[ord + 1]) * 7 % 101 - 1 AS DOUBLE) AS conf FROM (SELECT doc_id, w, unnest(range(len(w))) AS ord FROM (
              SELECT doc_id, {S.words(S.collapse('text'))} AS w FROM documents))"""),
    ),
)
def a12(c):
    split = T.words(T.collapse_whitespace("text"))
    words = T.unnest(c.documents, [F.col("doc_id").alias("page_id")], split, "word", "ord").select(
        "page_id", "ord", F.floor(F.col("ord") / 100).cast("int").alias("block"), F.lit(0).alias("paragraph"),
        F.floor(F.col("ord") / 10).cast("int").alias("line"), "word",
        (F.length("word") * 7 % 101 - 1).cast("double").alias("confidence"),
    )
    return X.rebuild_pages(words).select("page_id", "text", F.round("confidence", 6).alias("confidence"))


@query(
    "a13_pending_translation",
    with_views("""SELECT passage_id, work_slug, sequence_index FROM v_published p WHERE language <> 'en'
        AND NOT EXISTS (SELECT 1 FROM v_translation t WHERE t.passage_id = p.passage_id AND t.language = 'en')"""),
)
def a13(c):
    return A.pending_translation(c.published, c.translations, "en").select("passage_id", "work_slug", "sequence_index")


@query("a13_pending_ocr", with_views("SELECT page_id, image_index FROM v_scan_page WHERE ocr_raw_text IS NULL"))
def a13_ocr(c):
    return A.pending_ocr(c.scan_pages).select("page_id", "image_index")


@query(
    "a15_classification_source",
    with_views("""SELECT d.doc_id, w.tradition, CASE WHEN w.tradition <> 'UNCLASSIFIED' THEN 'list' END AS classification_source,
        CASE WHEN w.tradition <> 'UNCLASSIFIED' THEN 'http://list' END AS classification_source_url FROM documents d JOIN v_work w ON w.work_slug = d.source"""),
)
def a15(c):
    rows = c.table("documents").select("doc_id", F.col("source").alias("work_slug")).join(
        c.works.select("work_slug", "tradition"), "work_slug"
    )
    return A.with_classification_source(rows, "list", "http://list").drop("work_slug")


# --------------------------------------------------------------------------
# I: reports
# --------------------------------------------------------------------------

_STATS = """
    SELECT w.work_slug, w.tradition, w.corpus_state, w.catalogue_rank, count(p.passage_id) AS passage_count,
      count(DISTINCT CASE WHEN a.chapter IS NOT NULL THEN a.chapter * 1000 + a.verse_start END) AS verse_count
    FROM v_work w LEFT JOIN v_passage p ON p.work_slug = w.work_slug LEFT JOIN v_passage_verse a ON a.passage_id = p.passage_id GROUP BY ALL"""


def stats(c):
    return P.work_stats(c.works, c.unnumbered_passages, c.alignments)


@query("i1_work_stats", with_views("SELECT work_slug, passage_count, verse_count FROM v_stats", ("v_stats", _STATS)))
def i1(c):
    return stats(c).select("work_slug", "passage_count", "verse_count")


@query(
    "i1_supplier_stats",
    """SELECT 's' || s_suppkey AS work_slug, count(l_orderkey) AS passage_count, count(DISTINCT l_partkey) AS verse_count
    FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey""",
)
def i1_suppliers(c):
    works = c.table("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("work_slug"))
    # Line items have no key of their own, so they are numbered in a written copy.
    lines = materialise(c.table("lineitem").select(
        F.monotonically_increasing_id().alias("passage_id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("work_slug"),
        F.lit(1).alias("chapter"), F.col("l_partkey").alias("verse_start"),
    ))
    return P.work_stats(works, lines.select("passage_id", "work_slug"), lines.select("passage_id", "chapter", "verse_start"))


@query(
    "i2_catalogue",
    with_views(
        "SELECT work_slug, tradition, catalogue_rank, passage_count, verse_count FROM v_stats WHERE corpus_state = 'PUBLISHED'",
        ("v_stats", _STATS),
    ),
)
def i2(c):
    return P.catalogue(c.works, c.unnumbered_passages, c.alignments).select(
        "work_slug", "tradition", "catalogue_rank", "passage_count", "verse_count"
    )


def _preset(name, traditions, methods, default_only) -> str:
    clauses = ["corpus_state = 'PUBLISHED'"]
    if traditions:
        clauses.append(f"tradition IN ({S.quoted(traditions)})")
    if methods:
        clauses.append(f"method IN ({S.quoted(methods)})")
    if default_only:
        clauses.append("is_default")
    return f"""SELECT '{name}' AS preset, string_agg(work_slug, ',' ORDER BY catalogue_rank, work_slug) AS work_slugs, count(*) AS work_count
        FROM v_work WHERE {' AND '.join(clauses)} HAVING count(*) > 0"""


@query("i3_presets", with_views(" UNION ALL ".join(_preset(*p) for p in V.PRESETS)))
def i3(c):
    return P.resolve_presets(c.works).withColumn("work_slugs", F.array_join("work_slugs", ","))


@query(
    "i4_tradition_histogram",
    with_views(
        """SELECT coalesce(tradition, 'TOTAL') AS tradition, count(*) AS works, CAST(sum(passage_count) AS BIGINT) AS passages
        FROM v_stats GROUP BY ROLLUP (tradition)""",
        ("v_stats", _STATS),
    ),
)
def i4(c):
    return P.tradition_histogram(stats(c)).withColumn("tradition", F.coalesce("tradition", F.lit("TOTAL")))


def verified_pages(c):
    return c.scan_pages.withColumns(
        {
            "ocr_verified_text": F.when(F.col("page_id") % 30 == 2, F.col("ocr_raw_text")),
            "needs_review": F.col("ocr_raw_text").isNotNull() & (F.col("page_id") % 5 > 0),
        }
    )


_VERIFIED = """SELECT *, CASE WHEN page_id % 30 = 2 THEN ocr_raw_text END AS ocr_verified_text,
    ocr_raw_text IS NOT NULL AND page_id % 5 > 0 AS needs_review FROM v_scan_page"""


@query(
    "i5_source_status",
    with_views(
        """SELECT source_id, count(*) AS pages, count(ocr_raw_text) AS ocr_complete, count(ocr_verified_text) AS human_verified,
        round(avg(ocr_confidence), 3) AS mean_ocr_confidence, count(ocr_verified_text) > 0 AS citable FROM v_verified GROUP BY source_id""",
        ("v_verified", _VERIFIED),
    ),
)
def i5(c):
    return P.source_status(verified_pages(c))


@query(
    "i6_scan_status",
    with_views(
        """SELECT count(*) AS pages, count(ocr_raw_text) AS ocr_done, count(ocr_verified_text) AS verified,
        count(*) FILTER (WHERE needs_review) AS pending_review FROM v_verified""",
        ("v_verified", _VERIFIED),
    ),
)
def i6(c):
    return P.scan_status(verified_pages(c))


@query(
    "i7_translation_coverage",
    with_views("""SELECT language, count(*) AS n, count(*) FILTER (WHERE verification_status = 'VERIFIED') AS verified,
        round(count(*) * 100 / CAST((SELECT count(*) FROM v_published) AS DOUBLE), 3) AS percent FROM v_translation GROUP BY language"""),
)
def i7(c):
    return P.translation_coverage(c.translations, J.published_passages(c.unnumbered_passages, c.works))


@query(
    "i8_corpus_health",
    with_views("""SELECT 'passages' AS table_name, count(*) AS n FROM v_passage UNION ALL SELECT 'published', count(*) FROM v_published
        UNION ALL SELECT 'verses', count(*) FROM v_verse UNION ALL SELECT 'works', count(*) FROM v_work"""),
)
def i8(c):
    return P.corpus_health(
        {
            "passages": c.unnumbered_passages, "published": J.published_passages(c.unnumbered_passages, c.works),
            "verses": c.verses, "works": c.works,
        }
    )


@query(
    "i9_inspect_passages",
    with_views("""SELECT p.passage_id, length(p.raw_text) AS n_chars, a.chapter || ':' || a.verse_start || '-' || a.verse_end AS alignments,
        coalesce(t.names, '') AS translations FROM v_passage p JOIN v_passage_verse a ON a.passage_id = p.passage_id
        LEFT JOIN (SELECT passage_id, string_agg(translator_name, ',' ORDER BY translator_name) AS names FROM v_translation GROUP BY passage_id) t
        ON t.passage_id = p.passage_id"""),
)
def i9(c):
    rows = P.inspect_passages(c.unnumbered_passages, c.alignments, c.translations)
    place = lambda a: F.concat(
        a["chapter"].cast("string"), F.lit(":"), a["verse_start"].cast("string"), F.lit("-"), a["verse_end"].cast("string")
    )
    return rows.select(
        "passage_id", F.length("raw_text").cast("long").alias("n_chars"),
        F.array_join(F.transform("alignments", place), ",").alias("alignments"),
        F.coalesce(F.array_join(F.transform("translations", lambda t: t["translator_name"]), ","), F.lit("")).alias("translations"),
    )


@query(
    "i10_rule_listing",
    with_views(
        """SELECT rule_key, tier, CAST(tier_rank AS INT) AS tier_rank, priority, source_book, source_book <> 'BASELINE' AS attributed
        FROM v_rule WHERE is_active""",
        ("v_rule", _RULES),
    ),
)
def i10(c):
    return P.rule_listing(driver_rules(c))


@query(
    "i10_rule_counts",
    with_views(
        """SELECT count(*) FILTER (WHERE source_book = 'BASELINE') AS baseline, count(*) FILTER (WHERE source_book <> 'BASELINE') AS attributed
        FROM v_rule WHERE is_active""",
        ("v_rule", _RULES),
    ),
)
def i10_counts(c):
    return P.rule_counts(driver_rules(c))


@query(
    "i11_selections",
    with_views(f"""SELECT 'sunni' AS kind, work_slug FROM v_work WHERE tradition IN ({S.quoted(V.TRADITIONS_SUNNI)})
        UNION ALL SELECT 'unclassified', work_slug FROM v_work WHERE tradition = 'UNCLASSIFIED'
        UNION ALL SELECT 'commentaries', work_slug FROM v_work WHERE method IN ({S.quoted(V.COMMENTARY_METHODS)})
        UNION ALL SELECT 'default', work_slug FROM v_work WHERE is_default"""),
)
def i11(c):
    out = None
    for kind in ("sunni", "unclassified", "commentaries", "default"):
        rows = P.selection(c.works, kind).select(F.lit(kind).alias("kind"), "work_slug")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "i12_verse_table",
    with_views("""SELECT v.item_id, v.chapter, v.verse, v.text, replace(r_name, ' ', '') AS translit, CAST(8 AS INT) AS verse_count
        FROM v_verse v JOIN region ON r_regionkey + 1 = v.chapter"""),
)
def i12(c):
    return P.verse_table(c.verses, chapters(c).select("number", "translit", "verse_count"))


@query(
    "i12_page_table",
    with_views("""SELECT page_id, source_id, image_index, image_uri, r_name AS source_title FROM v_scan_page LEFT JOIN region ON r_regionkey = source_id"""),
)
def i12_pages(c):
    sources = c.table("region").select(F.col("r_regionkey").alias("source_id"), F.col("r_name").alias("source_title"))
    return P.page_table(c.scan_pages, sources).select("page_id", "source_id", "image_index", "image_uri", "source_title")


# --------------------------------------------------------------------------
# J: data quality
# --------------------------------------------------------------------------

@query(
    "j1_published_passages",
    with_views("SELECT passage_id, work_slug, language, verification_status FROM v_published"),
)
def j1(c):
    return J.published_passages(c.unnumbered_passages, c.works).select(
        "passage_id", "work_slug", "language", "verification_status"
    )


@query(
    "j2_row_checks",
    """SELECT 'passage_verse' AS table_name, CAST(k AS VARCHAR) AS row_key, 'alignment_range_order' AS rule FROM v WHERE z < a
      UNION ALL SELECT 'passage_verse', CAST(k AS VARCHAR), 'alignment_start_positive' FROM v WHERE a <= 0
      UNION ALL SELECT 'passage_verse', CAST(k AS VARCHAR), 'alignment_confidence_range' FROM v WHERE f < 0 OR f > 1
      UNION ALL SELECT 'passage_verse', CAST(k AS VARCHAR), 'status_domain' FROM v WHERE s NOT IN ('A', 'N')""".replace(
        " FROM v ",
        """ FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_suppkey % 50 AS a, l_suppkey % 50 + l_linenumber - 2 AS z,
          CASE WHEN l_linenumber <> 3 THEN l_discount * 11 END AS f, l_returnflag AS s FROM lineitem) v """,
    ),
)
def j2(c):
    rows = c.table("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), (F.col("l_suppkey") % 50).alias("verse_start"),
        (F.col("l_suppkey") % 50 + F.col("l_linenumber") - 2).alias("verse_end"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 11).alias("confidence"),
        F.col("l_returnflag").alias("status"),
    )
    return J.check(rows, "passage_verse", "k", {**J.RULES["passage_verse"], **J.enum_rules({"status": ["A", "N"]})})


@query(
    "j2_rule_checks",
    with_views(
        """SELECT 'scholarly_rule' AS table_name, rule_key AS row_key, 'rule_scholarly_needs_reference' AS rule FROM v_rule
          WHERE source_book <> 'BASELINE' AND source_reference IS NULL
        UNION ALL SELECT 'scholarly_rule', rule_key, 'rule_scholarly_needs_biblio' FROM v_rule WHERE source_book <> 'BASELINE'
        UNION ALL SELECT 'scholarly_rule', rule_key, 'rule_verified_needs_reviewer' FROM v_rule WHERE k % 3 = 0
        UNION ALL SELECT 'scholarly_rule', rule_key, 'rule_tier_matches_provenance' FROM v_rule
          WHERE (tier = 'SCHOLARLY_METHOD') <> (source_book <> 'BASELINE')""",
        ("v_rule", _RULES),
    ),
)
def j2_rules(c):
    k = F.substring("rule_key", F.lit(2), F.length("rule_key")).cast("int")
    rules = driver_rules(c).withColumns(
        {
            "biblio_source_id": F.lit(None).cast("string"), "verified_by": F.lit(None).cast("string"),
            "verified_at": F.lit(None).cast("timestamp"),
            "verification_status": F.when(k % 3 == 0, "VERIFIED").otherwise("UNVERIFIED"),
        }
    )
    return J.check(rules, "scholarly_rule", "rule_key", J.RULES["scholarly_rule"])


def _violations(rows: list[tuple[str, str, str, str]]) -> str:
    """UNION of (table, key expression, rule, FROM and WHERE)."""
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, CAST({key} AS VARCHAR) AS row_key, '{rule}' AS rule FROM {broken}" for table, key, rule, broken in rows
    )


@query(
    "j2_entity_checks",
    _violations([
        ("work", "s_suppkey", "classification_needs_source", "supplier WHERE s_suppkey % 5 <> 0 AND s_acctbal < 0"),
        ("passage", "o_orderkey", "passage_page_order", "orders WHERE o_custkey % 3 <> 0 AND o_orderkey % 11 < o_custkey % 7"),
        ("scan_page", "page_id", "page_exactly_one_parent", "pages WHERE page_id % 4 IN (0, 3)"),
        ("verse_summary", "conv_id * 100 + turn", "summary_is_synthesis", "conversations WHERE role = 'system'"),
        ("verse_summary", "conv_id * 100 + turn", "summary_has_evidence", "conversations WHERE turn % 3 = 0"),
        ("verse_summary", "conv_id * 100 + turn", "summary_counts_consistent", "conversations WHERE turn % 4 = 1"),
        ("author", "c_custkey", "author_years_ordered", "customer WHERE c_nationkey > 2 AND c_custkey % 25 < c_nationkey"),
        ("author_relation", "n_nationkey", "relation_not_self", "nation WHERE n_nationkey = n_regionkey"),
        ("clause", "event_id", "clause_word_order", "events WHERE event_id % 9 < event_id % 4 OR event_id % 13 = 0"),
    ]),
)
def j2_entities(c):
    col = F.col
    of = lambda name, key: c.table(name).withColumn("k", key)
    turn = of("conversations", col("conv_id") * 100 + col("turn"))
    sets = {
        "work": of("supplier", col("s_suppkey")).select(
            "k", F.when(col("s_suppkey") % 5 == 0, "UNCLASSIFIED").otherwise("SUNNI").alias("tradition"),
            F.when(col("s_acctbal") >= 0, col("s_name")).alias("classification_source"),
        ),
        "passage": of("orders", col("o_orderkey")).select(
            "k", F.when(col("o_custkey") % 3 != 0, col("o_custkey") % 7).alias("page_start"), (col("o_orderkey") % 11).alias("page_end")
        ),
        "scan_page": of("pages", col("page_id")).select(
            "k", F.when(col("page_id") % 4 < 2, col("page_id")).alias("edition_id"),
            F.when(col("page_id") % 4 % 3 == 0, F.lit(None)).when(col("page_id") % 4 == 2, col("url")).alias("biblio_source_id"),
        ).withColumn("edition_id", F.when(col("k") % 4 == 1, col("edition_id"))),
        "verse_summary": turn.select(
            "k", F.when(col("role") == "system", "CLAIM").otherwise("SYNTHESIS").alias("evidence_type"),
            F.when(col("turn") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array("conv_id")).alias("cited_passage_ids"),
            col("turn").alias("sentences_kept"), F.lit(1).alias("sentences_removed"),
            (col("turn") + F.when(col("turn") % 4 == 1, 2).otherwise(1)).alias("sentences_generated"),
        ),
        "author": of("customer", col("c_custkey")).select(
            "k", F.when(col("c_nationkey") > 2, col("c_nationkey")).alias("birth_year"), (col("c_custkey") % 25).alias("death_year")
        ),
        "author_relation": of("nation", col("n_nationkey")).select("k", col("n_nationkey").alias("from_author"), col("n_regionkey").alias("to_author")),
        "clause": of("events", col("event_id")).select(
            "k", (col("event_id") % 9).alias("end_word"),
            F.when(col("event_id") % 13 == 0, -1).otherwise(col("event_id") % 4).alias("start_word"),
        ),
    }
    found = [J.check(rows, name, "k", J.RULES[name]) for name, rows in sets.items()]
    return functools.reduce(lambda a, b: a.unionByName(b), found)


@query(
    "j5_restricted",
    "SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_linenumber = 7)",
)
def j5_restricted(c):
    held = c.table("lineitem").filter("l_linenumber = 7").select("l_suppkey")
    return J.restricted_deletes(held, c.table("supplier").filter("s_acctbal < 0"), "l_suppkey", "s_suppkey").select("s_suppkey")


@query(
    "j3_immutability",
    with_views("""SELECT CAST(page_id AS VARCHAR) AS row_key, 'ocr_raw_text' AS "column" FROM v_scan_page
        WHERE coalesce(trim(ocr_raw_text), '') <> '' AND page_id % 4 = 0
        UNION ALL SELECT CAST(page_id AS VARCHAR), 'image_uri' FROM v_scan_page WHERE page_id % 7 = 0"""),
)
def j3(c):
    p = F.col("page_id")
    new = c.scan_pages.withColumns(
        {
            "ocr_raw_text": F.when(p % 4 == 0, "changed").otherwise(F.col("ocr_raw_text")),
            "image_uri": F.when(p % 7 == 0, "moved").otherwise(F.col("image_uri")),
        }
    )
    return J.immutability_violations(c.scan_pages, new, "page_id", {"ocr_raw_text": True, "image_uri": False})


@query(
    "j4_duplicate_keys",
    """SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey, l_partkey HAVING count(*) > 1""",
)
def j4(c):
    return J.duplicate_keys(c.table("lineitem"), ["l_orderkey", "l_partkey"], "l_returnflag = 'A'")


@query(
    "j5_orphans",
    """SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id)""",
)
def j5(c):
    return J.orphans(c.table("conversations").select("conv_id", "turn"), c.table("labels"), "conv_id", "doc_id").select("conv_id", "turn")


@query(
    "j5_delete_rules",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_size > 45 THEN NULL ELSE l_partkey END AS nulled FROM lineitem
      JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus <> 'F'""",
)
def j5_deletes(c):
    lines = c.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").withColumn("nulled", F.col("l_partkey"))
    lines = lines.join(c.table("orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    lines = lines.join(c.table("part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    left = J.cascade_delete(lines, c.table("orders").filter("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey")
    return J.set_null_on_delete(left, c.table("part").filter("p_size > 45"), "nulled", "p_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "nulled"
    )


@query(
    "j6_corrections",
    with_views("""SELECT p.passage_id, coalesce(t.text, CASE WHEN p.passage_id % 2 = 0 THEN 'kept' END) AS verified_text, length(p.raw_text) AS raw_chars
        FROM v_passage p LEFT JOIN (SELECT conv_id, max_by(text, turn) AS text FROM conversations GROUP BY conv_id) t ON t.conv_id = p.passage_id"""),
)
def j6(c):
    passages = c.unnumbered_passages.select(
        "passage_id", "raw_text", F.when(F.col("passage_id") % 2 == 0, "kept").alias("verified_text")
    )
    log = c.table("conversations").select(
        F.col("conv_id").alias("passage_id"), F.col("turn").alias("correction_id"),
        F.col("text").alias("corrected_text"), F.col("turn").alias("corrected_at"),
    )
    return J.apply_corrections(passages, log).select(
        "passage_id", "verified_text", F.length("raw_text").cast("long").alias("raw_chars")
    )


@query(
    "j7_lifecycle_counts",
    f"""SELECT corpus_state, count(*) AS n, CAST(list_position([{S.quoted(V.CORPUS_STATES)}], corpus_state) AS INT) AS state_rank FROM (
      SELECT [{S.quoted(V.CORPUS_STATES)}][1 + doc_id % 11] AS corpus_state FROM documents) GROUP BY corpus_state""",
)
def j7(c):
    state = F.element_at(F.lit(V.CORPUS_STATES), (1 + F.col("doc_id") % 11).cast("int"))
    return J.lifecycle_counts(c.table("documents").select(state.alias("corpus_state")))


# --------------------------------------------------------------------------
# L: evaluation
# --------------------------------------------------------------------------

_RANKED = """
    SELECT query_id, passage_id, rank, CASE WHEN ql = pl THEN 1 ELSE 0 END AS rel FROM (
      SELECT q.vec_id AS query_id, p.vec_id AS passage_id, q.label AS ql, p.label AS pl, row_number() OVER (PARTITION BY q.vec_id ORDER BY
        round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) DESC, p.vec_id) AS rank
      FROM embeddings q, embeddings p WHERE q.vec_id <> p.vec_id) WHERE rank <= 10"""


def ranked_by_vector(c):
    e = c.table("embeddings")
    # The query itself always ranks among the first eleven; it is left out.
    found = Q.dense_search(
        e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        e.select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("vector")), limit=11,
    ).filter(F.col("query_id") != F.col("passage_id"))
    return Q.top_by(found.drop("rank"), ["query_id"], [F.desc("similarity"), "passage_id"], 10, "rank")


def judged(c):
    labels = c.table("embeddings").select("vec_id", "label")
    return (
        ranked_by_vector(c)
        .join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("_ql")), "query_id")
        .join(labels.select(F.col("vec_id").alias("passage_id"), F.col("label").alias("_pl")), "passage_id")
        .select("query_id", "passage_id", "rank", (F.col("_ql") == F.col("_pl")).cast("int").alias("relevance"))
    )


def relevant_totals(c):
    e = c.table("embeddings").select(F.col("vec_id").alias("query_id"), "label")
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    return e.join(sizes, "label").select("query_id", "n_relevant")


@query(
    "l1_ranking_metrics",
    with_views(
        """SELECT t.query_id, round(hits / 10.0, 6) AS precision_at_k, round(coalesce(hits / CAST(nullif(n_relevant, 0) AS DOUBLE), 0), 6) AS recall_at_k,
          round(coalesce(1.0 / first, 0), 6) AS reciprocal_rank,
          round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= n_relevant), 0), 6) AS ndcg_at_k
        FROM v_totals t LEFT JOIN (SELECT query_id, sum(rel) AS hits, min(rank) FILTER (WHERE rel = 1) AS first, sum(rel / log2(rank + 1)) AS dcg
          FROM v_ranked GROUP BY query_id) m ON m.query_id = t.query_id""",
        ("v_ranked", _RANKED),
        ("v_totals", "SELECT vec_id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS n_relevant FROM embeddings"),
    ),
)
def l1(c):
    return L.ranking_metrics(judged(c), relevant_totals(c), k=10)


@query(
    "l1_mean_metrics",
    with_views(
        """SELECT count(*) AS queries, round(avg(hits / 10.0), 6) AS precision_at_k, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr
        FROM (SELECT query_id, sum(rel) AS hits, min(rank) FILTER (WHERE rel = 1) AS first FROM v_ranked GROUP BY query_id)""",
        ("v_ranked", _RANKED),
    ),
)
def l1_mean(c):
    return L.mean_metrics(L.ranking_metrics(judged(c), relevant_totals(c), k=10)).select("queries", "precision_at_k", "mrr")


@query(
    "l2_breadth",
    with_views("""SELECT r.query_id, count(*) AS passages, count(DISTINCT p.work_slug) AS works_represented,
        round(count(*) FILTER (WHERE p.verification_status = 'VERIFIED') / CAST(count(*) AS DOUBLE), 6) AS verified_share
        FROM v_query_ref r JOIN v_passage_verse a ON a.chapter = r.chapter AND a.verse_start = r.verse_start
        JOIN v_published p ON p.passage_id = a.passage_id GROUP BY r.query_id"""),
)
def l2(c):
    # Counted per verse first, so that a popular verse meets its queries as one row.
    places = c.alignments.select("passage_id", "chapter", "verse_start")
    return L.breadth_by_place(
        c.query_refs.select("query_id", "chapter", "verse_start"),
        places.join(J.published_passages(c.unnumbered_passages, c.works).drop("raw_text"), "passage_id"),
    )


@query(
    "l2_claim_rates",
    """SELECT conv_id AS query_id, count(*) AS claims, round(count(*) FILTER (WHERE length(text) > 600) / CAST(count(*) AS DOUBLE), 6) AS evidence_coverage,
      round(count(*) FILTER (WHERE length(text) <= 600) / CAST(count(*) AS DOUBLE), 6) AS unsupported_rate
    FROM conversations WHERE role = 'assistant' GROUP BY conv_id""",
)
def l2_claims(c):
    claims = c.table("conversations").filter("role = 'assistant'").select(
        F.col("conv_id").alias("query_id"), (F.length("text") > 600).alias("supported")
    )
    return L.claim_rates(claims)


@query(
    "l3_relation_paths",
    """SELECT a.c_custkey AS start, n.n_nationkey AS via, r.n_regionkey AS finish FROM customer a JOIN nation n ON n.n_nationkey = a.c_nationkey
      JOIN nation r ON r.n_nationkey = n.n_nationkey""",
)
def l3(c):
    lives = c.table("customer").select(
        F.col("c_custkey").alias("from_id"), F.col("c_nationkey").alias("to_id"), F.lit("LIVES_IN").alias("relation")
    )
    lies = c.table("nation").select(
        F.col("n_nationkey").alias("from_id"), F.col("n_regionkey").alias("to_id"), F.lit("LIES_IN").alias("relation")
    )
    return L.two_hops(lives, lies).select("start", "via", "finish")


# --------------------------------------------------------------------------
# K: batch inference with a deterministic stand-in for a model
# --------------------------------------------------------------------------

@query(
    "k1_infer_pending",
    with_views(
        """SELECT passage_id, status, CASE WHEN status = 'fresh' THEN md5(replace(replace(upper(raw_text), 'ß', 'SS'), 'ẞ', 'SS')) WHEN status = 'passthrough' THEN md5(raw_text) END AS text_hash
        FROM (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM v_translation t WHERE t.passage_id = p.passage_id) THEN 'cached'
          WHEN language = 'en' THEN 'passthrough' WHEN language = 'de' THEN 'empty'
          WHEN d.reason IS NOT NULL THEN 'rejected' ELSE 'fresh' END AS status FROM v_published p LEFT JOIN v_degenerate d ON d.doc_id = p.passage_id)""",
        ("v_upper", "SELECT doc_id, upper(text) AS text FROM documents"), *degenerate_views("v_upper"),
    ),
)
def k1(c):
    out = K.infer_pending(c.published, c.translations, K.upper_case_translator, target="en", translator="upper")
    return out.select("passage_id", "status", F.md5("text").alias("text_hash"))


_K1_UNKNOWN = """
    SELECT passage_id, CASE WHEN passage_id % 9 <> 4 OR language = 'de' THEN language END AS language, raw_text FROM v_published"""


@query(
    "k1_sharded_inference",
    with_views(
        """SELECT passage_id, status, CASE WHEN status = 'fresh' THEN md5(replace(replace(upper(raw_text), 'ß', 'SS'), 'ẞ', 'SS')) WHEN status = 'passthrough' THEN md5(raw_text) END AS text_hash
        FROM (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM v_translation t WHERE t.passage_id = p.passage_id) THEN 'cached'
          WHEN language = 'en' THEN 'passthrough' WHEN language = 'de' THEN 'empty'
          WHEN d.reason IS NOT NULL THEN 'rejected' ELSE 'fresh' END AS status FROM v_partly_known p LEFT JOIN v_degenerate d ON d.doc_id = p.passage_id)""",
        ("v_upper", "SELECT doc_id, upper(text) AS text FROM documents"), *degenerate_views("v_upper"), ("v_partly_known", _K1_UNKNOWN),
    ),
)
def k1_shards(c):
    """Outcomes of passages some of whose languages nobody knows, committed shard by shard."""
    known = c.published.withColumn("language", F.when((F.col("passage_id") % 9 != 4) | (F.col("language") == "de"), F.col("language")))
    passages = materialise(known.select("passage_id", "language", "raw_text"))
    stored = materialise(c.translations)
    out = K.in_shards(
        passages, "passage_id", f"{shared_folder(c.spark)}/inference-{uuid.uuid4().hex}",
        lambda part: K.infer_pending(part, stored, K.upper_case_translator, target="en", translator="upper"), shards=4,
    )
    return out.select("passage_id", "status", F.md5("text").alias("text_hash"))


def squared_lengths(words: Column) -> Column:
    """Array of the squared length of the counts of words by place, empty where there is no word.

    A number's remainder by 16 is its last hexadecimal digit, so a text's places are one string of digits, made once
    (an array of one binds it) and asked 16 times by length.
    """
    digits = F.array_join(F.transform(words, lambda w: F.substring(F.md5(w), 8, 1)), "")

    def total(d: Column) -> Column:
        counts = [(F.length(d) - F.length(F.replace(d, F.lit(f"{i:x}"), F.lit("")))).cast("long") for i in range(16)]
        return functools.reduce(lambda a, b: a + b, [k * k for k in counts])

    return F.filter(F.transform(F.array(digits), total), lambda t: t > 0)


@query(
    "k2_embed_passages",
    with_views(
        f"""SELECT passage_id, array_to_string(list_transform(range(16), lambda i: coalesce(map_extract_value(n, i), 0) || '/' || total), ' ') AS vector
        FROM (SELECT passage_id, map_from_entries(list((place, k))) AS n, CAST(sum(k * k) AS BIGINT) AS total FROM (
          SELECT passage_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 16 AS place, count(*) AS k FROM (
            SELECT passage_id, unnest(list_filter(regexp_split_to_array(raw_text, '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '')) AS word FROM v_published)
          GROUP BY passage_id, place) GROUP BY passage_id)"""
    ),
)
def k2(c):
    # Squared lengths are whole numbers, so a unit vector tells the counts it came from exactly.
    vectors = K.embed_pending(
        c.unnumbered_published.withColumn("embedding", F.lit(None).cast("array<float>")), K.hashing_embedder(16), text="raw_text"
    )
    words = F.filter(F.split("raw_text", "[ \\t\\n\\x0b\\x0c\\r]+"), lambda w: w != "")
    asked = T.unnest(c.unnumbered_published, ["passage_id"], squared_lengths(words), "total")
    whole = F.transform("embedding", lambda v: F.concat(F.round(v * F.sqrt("total")).cast("long").cast("string"), F.lit("/"), F.col("total").cast("string")))
    return vectors.join(asked, "passage_id").select("passage_id", F.array_join(whole, " ").alias("vector"))
