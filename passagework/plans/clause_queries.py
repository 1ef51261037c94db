"""Registered queries: clauses (F), reading view (G), grounding (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.functions import vocab as V
from passagework.operators import clauses as C
from passagework.operators import grounding as G
from passagework.operators import reading as N
from passagework.operators.tables import upsert
from passagework.plans import sql_text as S
from passagework.plans.driver_views import with_views
from passagework.plans.registry import query
from passagework.session import materialise

_BRACKETS = "|".join(T.BRACKETS).replace("\\{", "[{]").replace("\\}", "[}]")
_OPENS = f"""regexp_matches(substr({S.collapse('raw_text')}, 1, 160), '{"|".join(V.CLAUSE_HEADERS)}|{_BRACKETS}')"""

CLAUSE_VIEWS = (
    ("v_quotes", f"""SELECT passage_id, chapter, verse, list_filter(list_transform(range(1, len(a) + 1), lambda i: {S.matching("CASE WHEN a[i] <> '' THEN a[i] ELSE b[i] END")}),
        lambda q: q <> '') AS quotes FROM (SELECT passage_id, chapter, verse, regexp_extract_all(raw_text, '{_BRACKETS}', 1) AS a,
          regexp_extract_all(raw_text, '{_BRACKETS}', 2) AS b FROM v_quoting)"""),
    ("v_long", """SELECT passage_id, chapter, verse, list_filter(list_transform(quotes, lambda q: string_split(q, ' ')), lambda q: len(q) >= 2) AS qs
        FROM v_quotes"""),
    ("v_q", "SELECT passage_id, chapter, verse, unnest(qs) AS q, unnest(range(len(qs))) AS ord FROM v_long"),
    ("v_start", """SELECT q.*, v.words, unnest(range(len(v.words))) AS s FROM v_q q
        JOIN v_verse_words v ON v.chapter = q.chapter AND v.verse = q.verse"""),
    ("v_same", """SELECT *, list_transform(range(1, least(len(q), len(words) - s) + 1), lambda i: words[s + i] = q[i]) AS same
        FROM v_start WHERE words[s + 1] = q[1]"""),
    ("v_span", """SELECT passage_id, chapter, verse, ord, s AS start_word,
          s + (CASE WHEN list_contains(same, false) THEN list_position(same, false) - 1 ELSE len(same) END) - 1 AS end_word
        FROM v_same QUALIFY row_number() OVER (PARTITION BY passage_id, chapter, verse, ord ORDER BY end_word - start_word DESC, s) = 1"""),
    ("v_support", """SELECT chapter, verse, start_word, end_word, count(DISTINCT passage_id) AS support FROM v_span
        GROUP BY chapter, verse, start_word, end_word"""),
    ("v_ranked", """SELECT chapter, verse, list([{'a': start_word, 'z': end_word, 'n': support}]
          ORDER BY support DESC, end_word - start_word, start_word) AS spans FROM v_support WHERE support >= 3 GROUP BY chapter, verse"""),
    ("v_accepted", """SELECT chapter, verse, list_reduce(spans, lambda acc, x: CASE WHEN len(list_filter(acc,
          lambda o: x[1].a <= o.z AND o.a <= x[1].z)) > 0 THEN acc ELSE list_concat(acc, x) END) AS accepted FROM v_ranked"""),
    ("v_accepted_row", "SELECT chapter, verse, unnest(accepted) AS x FROM v_accepted"),
    ("v_covered", "SELECT DISTINCT chapter, verse FROM v_quoting"),
    ("v_piece", """SELECT v.chapter, v.verse, v.words, v.display_words, coalesce(x.x.a, 0) AS a, coalesce(x.x.n, 0) AS support
        FROM v_verse_words v JOIN v_covered c ON c.chapter = v.chapter AND c.verse = v.verse
        LEFT JOIN v_accepted_row x ON x.chapter = v.chapter AND x.verse = v.verse WHERE len(v.words) > 0"""),
    ("v_bound", """SELECT *, row_number() OVER w - 1 AS clause_index, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE a END AS start_word,
          coalesce(lead(a) OVER w, len(words)) - 1 AS end_word FROM v_piece WINDOW w AS (PARTITION BY chapter, verse ORDER BY a)"""),
    ("v_clause", """SELECT chapter, verse, clause_index, start_word, end_word, support,
          array_to_string(display_words[start_word + 1 : end_word + 1], ' ') AS text,
          array_to_string(words[start_word + 1 : end_word + 1], ' ') AS normalized FROM v_bound"""),
    ("v_quoted_best", """SELECT passage_id, chapter, verse, start_word AS a, end_word AS z FROM v_span
        QUALIFY row_number() OVER (PARTITION BY passage_id, chapter, verse ORDER BY end_word - start_word DESC, ord) = 1"""),
    ("v_unquoted", f"""SELECT p.passage_id, p.chapter, p.verse, string_split({S.matching('p.raw_text')}, ' ') AS pw FROM v_quoting p
        ANTI JOIN v_quoted_best q ON q.passage_id = p.passage_id AND q.chapter = p.chapter AND q.verse = p.verse"""),
    ("v_position", """SELECT u.passage_id, u.chapter, u.verse, unnest(v.words) AS w, unnest(range(len(v.words))) AS pos, list_intersect(v.words, u.pw) AS held
        FROM v_unquoted u JOIN v_verse_words v ON v.chapter = u.chapter AND v.verse = u.verse"""),
    ("v_island", """SELECT passage_id, chapter, verse, w, pos, pos - row_number() OVER (PARTITION BY passage_id, chapter, verse ORDER BY pos) AS island
        FROM v_position WHERE list_contains(held, w) AND length(w) > 1"""),
    ("v_run", f"""SELECT passage_id, chapter, verse, min(pos) AS a, max(pos) AS z, count(*) AS n,
          count(*) FILTER (WHERE length(w) >= 4 AND w NOT IN ({S.quoted(V.CLAUSE_FUNCTION_WORDS)})) AS content
        FROM v_island GROUP BY passage_id, chapter, verse, island"""),
    ("v_overlap_best", """SELECT * FROM v_run WHERE content > 0
        QUALIFY row_number() OVER (PARTITION BY passage_id, chapter, verse ORDER BY content * 100 + n DESC, a) = 1"""),
    ("v_evidence", """SELECT passage_id, chapter, verse, 'QUOTED' AS basis, a, z FROM v_quoted_best
        UNION ALL SELECT passage_id, chapter, verse, 'OVERLAP', a, z FROM v_overlap_best WHERE n >= 2"""),
    ("v_aligned", """SELECT e.passage_id, e.chapter, e.verse, c.clause_index, e.basis,
          least(e.z, c.end_word) - greatest(e.a, c.start_word) + 1 AS matched_words,
          round((CASE WHEN e.basis = 'QUOTED' THEN 0.9 ELSE 0.55 END) * least(1.0,
            (least(e.z, c.end_word) - greatest(e.a, c.start_word) + 1) / CAST(c.end_word - c.start_word + 1 AS DOUBLE)), 3) AS confidence
        FROM v_evidence e JOIN v_clause c ON c.chapter = e.chapter AND c.verse = e.verse
        WHERE least(e.z, c.end_word) - greatest(e.a, c.start_word) + 1 > 0
        QUALIFY row_number() OVER (PARTITION BY e.passage_id, e.chapter, e.verse ORDER BY matched_words DESC, c.clause_index) = 1"""),
    ("v_opens", f"SELECT passage_id, chapter, verse, {_OPENS} AS opens_discussion FROM v_quoting"),
)


def oracle(body: str) -> str:
    return with_views(body, *CLAUSE_VIEWS)


def spans(c):
    return C.quoted_spans(c.quoting, C.verse_words(c.verses))


def clauses_of(c):
    return C.build_clauses(c.quoting, c.verses)


@query(
    "f1_extract_quotations",
    oracle("""SELECT passage_id, CAST(ord AS INT) AS ord, quotation FROM (
        SELECT passage_id, unnest(quotes) AS quotation, unnest(range(len(quotes))) AS ord FROM v_quotes)"""),
)
def f1(c):
    return C.extract_quotations(c.quoting)


@query(
    "f2_quoted_spans",
    oracle("""SELECT passage_id, chapter, verse, CAST(ord AS INT) AS ord, CAST(start_word AS INT) AS start_word,
        CAST(end_word AS INT) AS end_word FROM v_span"""),
)
def f2(c):
    keys = ["passage_id", "chapter", "verse"]
    return T.unnest(spans(c), keys, "spans", "s").select(*keys, "s.*")


@query(
    "f3_span_support",
    oracle("""SELECT chapter, verse, CAST(start_word AS INT) AS start_word, CAST(end_word AS INT) AS end_word, support FROM v_support"""),
)
def f3(c):
    return C.span_support(spans(c))


@query(
    "f4_accept_spans",
    oracle("""SELECT chapter, verse, CAST(x.a AS INT) AS start_word, CAST(x.z AS INT) AS end_word, x.n AS support FROM v_accepted_row"""),
)
def f4(c):
    rows = C.accept_spans(C.span_support(spans(c)))
    return rows.select("chapter", "verse", F.explode("accepted").alias("s")).select("chapter", "verse", "s.*")


@query(
    "f5_cover_verses",
    oracle("""SELECT chapter, verse, CAST(clause_index AS INT) AS clause_index, CAST(start_word AS INT) AS start_word,
        CAST(end_word AS INT) AS end_word, text, normalized, support FROM v_clause"""),
)
def f5(c):
    return clauses_of(c)[0]


@query(
    "f6_align_passages",
    oracle("""SELECT a.passage_id, a.chapter, a.verse, CAST(clause_index AS INT) AS clause_index, basis,
        CAST(matched_words AS INT) AS matched_words, confidence, opens_discussion
        FROM v_aligned a JOIN v_opens o ON o.passage_id = a.passage_id AND o.chapter = a.chapter AND o.verse = a.verse"""),
)
def f6(c):
    return clauses_of(c)[1].drop("gist")


@query(
    "f7_clause_report",
    oracle("""SELECT c.chapter, c.verse, clauses, passages, coalesce(aligned, 0) AS aligned,
          round(coalesce(aligned, 0) / CAST(passages AS DOUBLE), 3) AS aligned_share
        FROM (SELECT chapter, verse, count(*) AS clauses FROM v_clause GROUP BY chapter, verse) c
        JOIN (SELECT chapter, verse, count(*) AS passages FROM v_quoting GROUP BY chapter, verse) p ON p.chapter = c.chapter AND p.verse = c.verse
        LEFT JOIN (SELECT chapter, verse, count(*) AS aligned FROM v_aligned GROUP BY chapter, verse) a ON a.chapter = c.chapter AND a.verse = c.verse"""),
)
def f7(c):
    clauses, aligned = clauses_of(c)
    return C.clause_report(clauses, c.quoting, aligned)


def _shingles(table: str, key: str) -> str:
    return f"""SELECT {key}, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS gram FROM (
        SELECT {key}, w, unnest(range(len(w) - 4)) AS pos FROM (SELECT {key}, {S.words(S.matching('text'))} AS w FROM {table}) WHERE len(w) >= 5)"""


@query(
    "f8_mine_quotations",
    with_views(
        """SELECT doc_id, item_id, CAST(min(dp) AS INT) AS doc_start, CAST(min(ip) AS INT) AS item_start, CAST(count(*) + 4 AS INT) AS words
        FROM (SELECT *, ip - row_number() OVER (PARTITION BY doc_id, item_id, dp - ip ORDER BY ip) AS island FROM (
          SELECT d.doc_id, i.item_id, d.pos AS dp, i.pos AS ip FROM v_doc_grams d JOIN v_item_grams i ON i.gram = d.gram))
        GROUP BY doc_id, item_id, dp - ip, island""",
        ("v_doc_grams", _shingles("documents", "doc_id")), ("v_item_grams", _shingles("benchmark", "item_id")),
    ),
)
def f8(c):
    return C.mine_quotations(c.documents.select("doc_id", "text"), c.table("benchmark"))


# --------------------------------------------------------------------------
# Reading view
# --------------------------------------------------------------------------

READING_VIEWS = (
    *CLAUSE_VIEWS,
    ("v_note", """SELECT a.passage_id, a.chapter, a.verse_start AS verse, p.work_slug, p.sequence_index, w.catalogue_rank,
          x.clause_index, coalesce(x.basis, 'UNALIGNED') AS basis, x.confidence,
          CASE WHEN x.clause_index IS NOT NULL THEN o.opens_discussion END AS opens
        FROM v_passage_verse a JOIN v_published p ON p.passage_id = a.passage_id JOIN v_work w ON w.work_slug = p.work_slug
        LEFT JOIN v_aligned x ON x.passage_id = a.passage_id AND x.chapter = a.chapter AND x.verse = a.verse_start
        LEFT JOIN v_opens o ON o.passage_id = a.passage_id AND o.chapter = a.chapter AND o.verse = a.verse_start"""),
    ("v_ranked_note", """SELECT *, row_number() OVER (PARTITION BY chapter, verse, clause_index, work_slug
            ORDER BY CASE WHEN opens THEN 0 ELSE 1 END, sequence_index, passage_id) AS note_rank,
          count(*) OVER (PARTITION BY chapter, verse, clause_index, work_slug) AS available,
          bool_or(coalesce(opens, false)) OVER (PARTITION BY chapter, verse, clause_index, work_slug) AS has_opening FROM v_note"""),
    ("v_capped", "SELECT * FROM v_ranked_note WHERE note_rank <= 3 AND (clause_index IS NULL OR has_opening)"),
    ("v_flag", """SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM v_capped n WHERE n.chapter = c.chapter AND n.verse = c.verse
          AND n.clause_index = c.clause_index) THEN 1 ELSE 0 END AS noted FROM v_clause c"""),
    ("v_grouped", """SELECT *, greatest(1, sum(noted) OVER (PARTITION BY chapter, verse ORDER BY clause_index)) AS group_index FROM v_flag"""),
    ("v_group", """SELECT chapter, verse, group_index, min(clause_index) AS clause_index, string_agg(text, ' ' ORDER BY clause_index) AS text,
          max(support) AS support FROM v_grouped GROUP BY chapter, verse, group_index"""),
    ("v_placed", """SELECT n.*, coalesce(g.group_index, 0) AS group_index FROM v_capped n LEFT JOIN v_grouped g
        ON g.chapter = n.chapter AND g.verse = n.verse AND g.clause_index = n.clause_index"""),
)


def reading_oracle(body: str) -> str:
    return with_views(body, *READING_VIEWS)


def notes_of(c):
    clauses, aligned = clauses_of(c)
    aligned = materialise(aligned)
    return clauses, N.reading_notes(c.alignments, c.published, aligned, c.works)


def reading(c):
    clauses, notes = notes_of(c)
    return N.build_reading(materialise(clauses), materialise(notes))


@query(
    "g1_reading_notes",
    reading_oracle("""SELECT passage_id, chapter, verse, work_slug, sequence_index, catalogue_rank,
        CAST(clause_index AS INT) AS clause_index, basis, confidence FROM v_note"""),
)
def g1(c):
    return notes_of(c)[1].select(
        "passage_id", "chapter", "verse", "work_slug", "sequence_index", "catalogue_rank", "clause_index", "basis", "confidence"
    )


@query(
    "g2_capped_notes",
    reading_oracle("""SELECT passage_id, chapter, verse, work_slug, CAST(clause_index AS INT) AS clause_index,
        CAST(note_rank AS INT) AS note_rank, available FROM v_capped"""),
)
def g2(c):
    return N.capped_notes(notes_of(c)[1]).select(
        "passage_id", "chapter", "verse", "work_slug", "clause_index", "note_rank", "available"
    )


@query(
    "g3_availability",
    reading_oracle("""SELECT chapter, verse, CAST(coalesce(clause_index, -1) AS INT) AS clause_index, work_slug, count(*) AS available
        FROM v_note GROUP BY chapter, verse, clause_index, work_slug"""),
)
def g3(c):
    return N.note_counts(notes_of(c)[1]).withColumnRenamed("_clause", "clause_index").drop("_has_opening")


@query(
    "g4_folded_clauses",
    reading_oracle("""SELECT chapter, verse, CAST(group_index AS INT) AS group_index, CAST(clause_index AS INT) AS clause_index,
        text, support FROM v_group"""),
)
def g4(c):
    return reading(c)["clauses"].drop("first_clause", "last_clause")


@query(
    "g5_placed_notes",
    reading_oracle("SELECT passage_id, chapter, verse, CAST(group_index AS INT) AS group_index, basis FROM v_placed"),
)
def g5(c):
    return reading(c)["notes"].select("passage_id", "chapter", "verse", "group_index", "basis")


@query(
    "g6_reading_references",
    reading_oracle("""SELECT chapter, verse, work_slug, CAST(row_number() OVER (PARTITION BY chapter, verse ORDER BY g, r, work_slug) AS INT) AS number
        FROM (SELECT chapter, verse, work_slug, min(CASE WHEN group_index = 0 THEN 1000000 ELSE group_index END) AS g, min(catalogue_rank) AS r
          FROM v_placed GROUP BY chapter, verse, work_slug)"""),
)
def g6(c):
    return reading(c)["references"]


@query(
    "g6_scholars_per_clause",
    reading_oracle("""SELECT chapter, verse, CAST(group_index AS INT) AS group_index, count(DISTINCT work_slug) AS scholar_count
        FROM v_placed WHERE group_index > 0 GROUP BY chapter, verse, group_index"""),
)
def g6_scholars(c):
    return reading(c)["scholars"]


@query(
    "g7_reading_counts",
    reading_oracle("""SELECT g.chapter, g.verse, count(*) AS clauses,
          (SELECT count(*) FROM v_placed p WHERE p.chapter = g.chapter AND p.verse = g.verse) AS notes_shown,
          (SELECT count(*) FROM v_placed p WHERE p.chapter = g.chapter AND p.verse = g.verse AND group_index = 0) AS further,
          (SELECT count(DISTINCT work_slug) FROM v_placed p WHERE p.chapter = g.chapter AND p.verse = g.verse) AS works,
          (SELECT count(*) FROM v_note n WHERE n.chapter = g.chapter AND n.verse = g.verse) AS notes_available
        FROM v_group g GROUP BY g.chapter, g.verse"""),
)
def g7(c):
    return reading(c)["counts"]


# --------------------------------------------------------------------------
# Grounding
# --------------------------------------------------------------------------

_FOREIGN = "[0-9]{2,}"
GROUNDING_VIEWS = (
    *READING_VIEWS,
    ("v_pick", """SELECT chapter, verse, passage_id, work_slug, row_number() OVER (PARTITION BY chapter, verse ORDER BY work_slug) AS marker
        FROM (SELECT * FROM v_note QUALIFY row_number() OVER (PARTITION BY chapter, verse, work_slug
          ORDER BY CASE WHEN opens THEN 0 ELSE 1 END, sequence_index, passage_id) = 1) QUALIFY marker <= 10"""),
    ("v_generated", """SELECT conv_id * 100 + turn AS output_id, conv_id % 5 + 1 AS chapter, conv_id % 8 + 1 AS verse, text
        FROM conversations WHERE role = 'assistant'"""),
    ("v_split", f"""SELECT output_id, chapter, verse, list_filter(list_transform(string_split(regexp_replace(regexp_replace(
          {S.strip("regexp_replace(text, '[^' || chr(92) || 'S' || chr(10) || ']+', ' ', 'g')")},
          '([.؟!۔])[{S.WS}]+', chr(92) || '1' || chr(2), 'g'), chr(10) || '+', chr(2), 'g'), chr(2)), lambda s: {S.strip('s')}),
          lambda s: length(s) >= 15) AS ss FROM v_generated"""),
    ("v_sentence", f"""SELECT output_id, chapter, verse, ord, {S.strip("regexp_replace(s, '[[]([0-9]{1,2})[]]', '', 'g')")} AS sentence,
          regexp_extract_all(s, '[[]([0-9]{{1,2}})[]]', 1) AS declared
        FROM (SELECT output_id, chapter, verse, unnest(ss) AS s, unnest(range(len(ss))) AS ord FROM v_split)"""),
    ("v_asked", f"SELECT *, {S.content_words(S.matching('sentence'))} AS words FROM v_sentence"),
    ("v_held", f"""SELECT k.chapter, k.verse, k.marker, k.passage_id, {S.content_words(S.matching('p.raw_text'))} AS held
        FROM v_pick k JOIN v_passage p ON p.passage_id = k.passage_id"""),
    ("v_score", """SELECT a.output_id, a.ord, h.marker, len(list_intersect(a.words, h.held)) / CAST(len(a.words) AS DOUBLE) AS share
        FROM v_asked a JOIN v_held h ON h.chapter = a.chapter AND h.verse = a.verse WHERE len(a.words) > 0"""),
    ("v_best", "SELECT output_id, ord, max(share) AS best FROM v_score GROUP BY output_id, ord"),
    ("v_cited", """SELECT s.output_id, s.ord, list(s.marker ORDER BY s.marker) AS citations FROM v_score s
        JOIN v_best b ON b.output_id = s.output_id AND b.ord = s.ord WHERE s.share >= 0.2 AND s.share >= b.best * 0.75 GROUP BY s.output_id, s.ord"""),
    ("v_judged", f"""SELECT a.output_id, a.chapter, a.verse, a.ord, a.sentence, len(a.words) AS n, coalesce(b.best, 0) AS best,
          CASE WHEN len(a.words) > 0 THEN len(list_intersect(a.words, {S.content_words(S.matching('v.text'))})) / CAST(len(a.words) AS DOUBLE)
            ELSE 0 END AS echo, c.citations, regexp_matches(a.sentence, '{_FOREIGN}') AS corrupt
        FROM v_asked a LEFT JOIN v_verse v ON v.chapter = a.chapter AND v.verse = a.verse
        LEFT JOIN v_best b ON b.output_id = a.output_id AND b.ord = a.ord LEFT JOIN v_cited c ON c.output_id = a.output_id AND c.ord = a.ord"""),
    ("v_verdict", """SELECT *, CASE WHEN corrupt THEN 'foreign script inside the text' WHEN echo > 0.6 THEN 'restates the verse'
          WHEN best > 0.92 AND n > 6 THEN 'reproduces the passage' WHEN citations IS NULL THEN 'no passage supports this sentence' END AS reason
        FROM v_judged"""),
    ("v_summary", """SELECT output_id, chapter, verse, count(*) AS sentences_generated, count(*) FILTER (WHERE reason IS NULL) AS sentences_kept,
          count(*) FILTER (WHERE reason IS NOT NULL) AS sentences_removed, round(avg(round(best, 3)) FILTER (WHERE reason IS NULL), 3) AS mean_support
        FROM v_verdict GROUP BY output_id, chapter, verse"""),
    ("v_available", "SELECT chapter, verse, count(*) AS n_passages FROM v_pick GROUP BY chapter, verse"),
)


def grounding_oracle(body: str) -> str:
    return with_views(body, *GROUNDING_VIEWS)


def evidence(c):
    picked = G.pick_evidence(notes_of(c)[1])
    texts = c.unnumbered_passages.select("passage_id", F.col("raw_text").alias("text"))
    return materialise(picked.join(texts, "passage_id"))


def generated(c):
    i = F.col("conv_id")
    return c.table("conversations").filter("role = 'assistant'").select(
        (i * 100 + F.col("turn")).alias("output_id"), (i % 5 + 1).alias("chapter"), (i % 8 + 1).alias("verse"), "text"
    )


def verdicts(c, picked):
    return G.verify_sentences(
        G.split_generated(generated(c)), picked, c.verses, ["output_id"], foreign=_FOREIGN
    )


@query("h1_pick_evidence", grounding_oracle("SELECT chapter, verse, CAST(marker AS INT) AS marker, passage_id, work_slug FROM v_pick"))
def h1(c):
    return G.pick_evidence(notes_of(c)[1])


@query(
    "h2_split_generated",
    grounding_oracle("""SELECT output_id, CAST(ord AS INT) AS ord, sentence, len(declared) AS n_declared FROM v_sentence"""),
)
def h2(c):
    return G.split_generated(generated(c)).select(
        "output_id", "ord", "sentence", F.size("declared").cast("long").alias("n_declared")
    )


@query(
    "h3_support_scores",
    grounding_oracle("""SELECT output_id, CAST(ord AS INT) AS ord, CAST(marker AS INT) AS marker, round(share, 6) AS share
        FROM v_score WHERE share > 0"""),
)
def h3(c):
    s = G.split_generated(generated(c)).withColumn("words", T.content_words(T.matching_form("sentence")))
    scores = G.support_scores(s, evidence(c), ["output_id"])
    sizes = s.select("output_id", "ord", F.size("words").alias("n"))
    return scores.join(sizes, ["output_id", "ord"]).select(
        "output_id", "ord", "marker", F.round(F.col("shared") / F.col("n"), 6).alias("share")
    )


@query(
    "h4_verse_echo",
    grounding_oracle("SELECT output_id, CAST(ord AS INT) AS ord, round(echo, 3) AS echo FROM v_verdict"),
)
def h4(c):
    return verdicts(c, evidence(c)).select("output_id", "ord", "echo")


@query(
    "h5_verify_sentences",
    grounding_oracle("""SELECT output_id, CAST(ord AS INT) AS ord, reason IS NULL AS kept, reason,
        CASE WHEN corrupt OR echo > 0.6 THEN 0.0 ELSE round(best, 3) END AS support,
        CASE WHEN corrupt OR echo > 0.6 THEN '' ELSE coalesce(array_to_string(citations, ','), '') END AS citations FROM v_verdict"""),
)
def h5(c):
    return verdicts(c, evidence(c)).select(
        "output_id", "ord", "kept", "reason", "support", F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations")
    )


@query(
    "h6_summarise_verdicts",
    grounding_oracle("""SELECT s.output_id, sentences_generated, sentences_kept, sentences_removed, mean_support,
        CASE WHEN coalesce(n_passages, 0) < 3 THEN 'too few passages' WHEN sentences_kept = 0 THEN 'no traceable sentence' END AS note,
        (SELECT count(DISTINCT m) FROM (SELECT unnest(citations) AS m FROM v_verdict v WHERE v.output_id = s.output_id AND reason IS NULL)) AS n_cited
        FROM v_summary s LEFT JOIN v_available a ON a.chapter = s.chapter AND a.verse = s.verse"""),
)
def h6(c):
    picked = evidence(c)
    return G.summarise_verdicts(verdicts(c, picked), picked, ["output_id"]).select(
        "output_id", "sentences_generated", "sentences_kept", "sentences_removed", "mean_support", "note",
        F.coalesce(F.size("cited_passage_ids"), F.lit(0)).cast("long").alias("n_cited"),
    )


@query(
    "h7_summary_upsert",
    """SELECT chapter, verse, selection_key, max_by(text, turn) AS summary_text, count(*) > 1 AS rewritten FROM (
      SELECT conv_id % 114 + 1 AS chapter, conv_id AS verse, turn, text,
        CASE WHEN conv_id % 3 = 0 THEN '*' ELSE 'src' || least(conv_id % 7, conv_id % 5) || ',src' || greatest(conv_id % 7, conv_id % 5) END AS selection_key
      FROM conversations WHERE role = 'assistant') GROUP BY chapter, verse, selection_key""",
)
def h7(c):
    i = F.col("conv_id")
    slugs = F.when(
        i % 3 != 0, F.array(F.concat(F.lit("src"), (i % 7).cast("string")), F.concat(F.lit("src"), (i % 5).cast("string")))
    )
    rows = c.table("conversations").filter("role = 'assistant'").select(
        (i % 114 + 1).alias("chapter"), i.alias("verse"), G.selection_key(slugs).alias("selection_key"), "turn", "text"
    )
    keys = ["chapter", "verse", "selection_key"]
    facts = rows.groupBy(*keys).agg(
        F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("last"), F.count("*").alias("n")
    )
    stored = facts.select(*keys, F.col("first").alias("summary_text"), F.lit(False).alias("rewritten"))
    fresh = facts.filter("n > 1").select(*keys, F.col("last").alias("summary_text"), F.lit(True).alias("rewritten"))
    return upsert(stored, fresh, keys, {"summary_text": "new", "rewritten": "new"})


@query(
    "h8_fabricated_citations",
    grounding_oracle("""SELECT q.query_id, q.conv_id AS passage_id FROM (
        SELECT conv_id * 100 + turn AS query_id, conv_id, conv_id % 5 + 1 AS chapter, conv_id % 8 + 1 AS verse FROM conversations) q
        ANTI JOIN v_passage_verse a ON a.passage_id = q.conv_id AND a.chapter = q.chapter AND a.verse_start = q.verse"""),
)
def h8(c):
    i = F.col("conv_id")
    cited = c.table("conversations").select(
        (i * 100 + F.col("turn")).alias("query_id"), i.alias("passage_id"), (i % 5 + 1).alias("chapter"), (i % 8 + 1).alias("verse")
    )
    placed = c.alignments.select("passage_id", "chapter", F.col("verse_start").alias("verse"))
    citable = cited.join(placed, ["passage_id", "chapter", "verse"], "left_semi")
    return G.fabricated_citations(cited, citable, ["query_id"]).select("query_id", "passage_id")
