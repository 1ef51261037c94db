"""The driver tables seen as a commentary corpus.

Each view exists twice: as a DataFrame here and as SQL text in `VIEWS`, which the
oracle side puts in front of its query as common table expressions.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators.clauses import passages_by_verse, verse_words
from passagework.operators.lexical import LexicalIndex, build_index, search_tokens
from passagework.operators.quality import published_passages
from passagework.operators.tables import bounded, id_bucket, number_within, spread
from passagework.plans import sql_text as S

# Letters that carry Latin words into Arabic script, so that the script-aware
# steps run over whole tables: plain, with vowel marks, and with Urdu letters.
LATIN = "abcdefghijklmnopqrstuvwxyz0123456789.,"
AS_ARABIC = "\u0623\u0628\u0629\u062f\u0649\u0641\u062c\u0647\u0625\u0630\u0643\u0644\u0645\u0646\u0624\u062b\u0642\u0631\u0633\u062a\u0626\u0648\u0639\u062e\u064a\u0632\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669.\u060c"
AS_VOWELLED = "\u064e\u0628\u0635\u062f\u0650\u0641\u063a\u062d\u0651\u0630\u0643\u0644\u0645\u0646\u0622\u0638\u0642\u0631\u0633\u062a\u0671\u0648\u0621\u062e\u0640\u0632\u06f0\u06f1\u06f2\u06f3\u06f4\u06f5\u06f6\u06f7\u06f8\u06f9.\u061b"
AS_URDU = "\u0627\u067e\u0686\u0688\u06d2\u0641\u06af\u06c1\u06cc\u0698\u06a9\u0644\u0645\u06ba\u0648\u0628\u0642\u0691\u0633\u0679\u0639\u0648\u0648\u062e\u06cc\u0632\u06f0\u06f1\u06f2\u06f3\u06f4\u06f5\u06f6\u06f7\u06f8\u06f9\u06d4\u060c"

VIEWS = {
    "v_work": """
        SELECT work_slug, n, CASE WHEN n % 3 = 0 THEN NULL ELSE 60 + n * 70 END AS death_year,
          CASE n % 4 WHEN 0 THEN 'SUNNI' WHEN 1 THEN 'SUNNI_SALAFI' WHEN 2 THEN 'MUTAZILA'
            ELSE 'UNCLASSIFIED' END AS tradition,
          CASE n % 3 WHEN 0 THEN 'BI_AL_MATHUR' WHEN 1 THEN 'FIQHI' ELSE 'LUGHAWI' END AS method,
          CASE WHEN n = 19 THEN 'HUMAN_REVIEW' ELSE 'PUBLISHED' END AS corpus_state,
          (n * 7) % 20 * 10 AS catalogue_rank, n % 2 = 0 AS is_default
        FROM (SELECT DISTINCT source AS work_slug, CAST(substr(source, 4) AS INT) AS n FROM documents) t""",
    "v_passage": """
        SELECT d.doc_id AS passage_id, d.source AS work_slug, d.lang AS language, d.text AS raw_text,
          row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS sequence_index,
          CASE WHEN l.toxic = 1 THEN 'DISPUTED' WHEN l.quality = 1 THEN 'VERIFIED'
            WHEN l.quality = 0 THEN 'UNVERIFIED' ELSE 'MACHINE_PROPOSED' END AS verification_status,
          CASE WHEN d.doc_id % 4 = 0 THEN 1 + d.doc_id % 7 END AS volume,
          CASE WHEN d.doc_id % 4 = 0 THEN 1 + d.doc_id % 300 END AS page_start
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "v_published": """
        SELECT p.* FROM v_passage p JOIN v_work w ON w.work_slug = p.work_slug
        WHERE p.verification_status NOT IN ('FIXTURE', 'DISPUTED') AND w.corpus_state = 'PUBLISHED'""",
    "v_verse": """
        SELECT item_id, item_id % 5 + 1 AS chapter, CAST(floor(item_id / 5) AS BIGINT) + 1 AS verse, text
        FROM benchmark""",
    "v_passage_verse": """
        SELECT doc_id AS passage_id, doc_id % 5 + 1 AS chapter,
          CAST(floor(doc_id / 5) AS BIGINT) % 8 + 1 AS verse_start,
          least(8, CAST(floor(doc_id / 5) AS BIGINT) % 8 + 1 + doc_id % 3) AS verse_end FROM documents""",
    "v_query": """
        SELECT conv_id * 100 + turn AS query_id, text FROM conversations WHERE role = 'user'""",
    "v_query_ref": """
        SELECT query_id, query_id % 5 + 1 AS chapter, query_id % 8 + 1 AS verse_start,
          least(8, query_id % 8 + 1 + query_id % 2) AS verse_end FROM v_query""",
    "v_translation": """
        SELECT conv_id AS passage_id, 'en' AS language, text,
          CASE WHEN role = 'system' THEN 'HUMAN' ELSE 'MACHINE' END AS translator_kind,
          concat('t', CAST(turn AS VARCHAR)) AS translator_name,
          CASE WHEN turn % 2 = 0 THEN 'VERIFIED' ELSE 'MACHINE_PROPOSED' END AS verification_status
        FROM conversations WHERE role <> 'user'""",
    "v_scan_page": """
        SELECT page_id, page_id % 4 AS source_id, CAST(floor(page_id / 4) AS BIGINT) AS image_index,
          url AS image_uri,
          CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE url END AS ocr_raw_text,
          CASE WHEN page_id % 3 = 2 THEN (page_id % 100) / CAST(100 AS DOUBLE) END AS ocr_confidence
        FROM pages""",
    "v_verse_words": f"""
        SELECT item_id, chapter, verse, {S.words(S.matching('text'))} AS words,
          {S.words(S.collapse('text'))} AS display_words FROM v_verse""",
    "v_quoting": """
        SELECT p.passage_id, v.chapter, v.verse, CASE WHEN p.passage_id % 3 <> 0 THEN '\ufd3f' || array_to_string(
            v.words[1 + p.passage_id // 40 % 4 * 5 : 4 + p.passage_id // 40 % 4 * 5 + p.passage_id // 160 % 2], ' ')
            || '\ufd3e ' || p.raw_text ELSE p.raw_text END AS raw_text
        FROM v_passage_verse a JOIN v_passage p ON p.passage_id = a.passage_id
        JOIN v_verse_words v ON v.chapter = a.chapter AND v.verse = a.verse_start""",
    "v_scripted": f"""
        SELECT doc_id, lang, CASE lang WHEN 'fr' THEN translate(lower(text), '{LATIN}', '{AS_ARABIC}')
          WHEN 'de' THEN translate(lower(text), '{LATIN}', '{AS_VOWELLED}')
          WHEN 'es' THEN translate(lower(text), '{LATIN}', '{AS_URDU}') ELSE text END AS text
        FROM documents""",
}


def with_views(body: str, *extra: tuple[str, str]) -> str:
    """Prefix an oracle query with the views it names, and any of its own."""
    named = {**VIEWS, **dict(extra)}
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name, text in named.items():
            if name not in needed and text is not sql and re.search(rf"\b{name}\b", sql):
                visit(text)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({named[n]})" for n in needed)
    return f"WITH {ctes}\n{body}"


#: Stored indexes of this process, by the state of their tables.
_INDEXES: dict[tuple, LexicalIndex] = {}


def files_of(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of change of each file of a table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(folder)))


class DriverCorpus:
    """Views over the driver tables, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        """Documents for jobs whose cost is in the text."""
        return spread(self.table("documents"))

    @cached_property
    def works(self) -> DataFrame:
        n = F.col("n")
        named = (
            self.table("documents").select(F.col("source").alias("work_slug")).distinct()
            .withColumn("n", F.substring("work_slug", F.lit(4), F.length("work_slug")).cast("int"))
        )
        return bounded(
            named.withColumns(
                {
                    "death_year": F.when(n % 3 != 0, 60 + n * 70),
                    "tradition": F.when(n % 4 == 0, "SUNNI").when(n % 4 == 1, "SUNNI_SALAFI")
                    .when(n % 4 == 2, "MUTAZILA").otherwise("UNCLASSIFIED"),
                    "method": F.when(n % 3 == 0, "BI_AL_MATHUR").when(n % 3 == 1, "FIQHI").otherwise("LUGHAWI"),
                    "corpus_state": F.when(n == 19, "HUMAN_REVIEW").otherwise("PUBLISHED"),
                    "catalogue_rank": (n * 7) % 20 * 10,
                    "is_default": n % 2 == 0,
                }
            )
        )

    @cached_property
    def unnumbered_passages(self) -> DataFrame:
        cited = F.col("passage_id") % 4 == 0
        return (
            self.documents
            .join(self.table("labels"), "doc_id", "left")
            .select(
                F.col("doc_id").alias("passage_id"), F.col("source").alias("work_slug"),
                F.col("lang").alias("language"), F.col("text").alias("raw_text"),
                F.when(F.col("toxic") == 1, "DISPUTED").when(F.col("quality") == 1, "VERIFIED")
                .when(F.col("quality") == 0, "UNVERIFIED").otherwise("MACHINE_PROPOSED")
                .alias("verification_status"),
            )
            .withColumns(
                {
                    "volume": F.when(cited, 1 + F.col("passage_id") % 7),
                    "page_start": F.when(cited, 1 + F.col("passage_id") % 300),
                }
            )
        )

    @cached_property
    def passages(self) -> DataFrame:
        # Numbers are taken on two narrow columns and joined back, so the texts
        # are not moved for the numbering.
        numbers = number_within(
            self.table("documents").select(
                F.col("doc_id").alias("passage_id"), F.col("source").alias("work_slug")
            ),
            ["work_slug"], ["passage_id"], id_bucket("passage_id"),
        ).select("passage_id", "sequence_index")
        return self.unnumbered_passages.join(numbers, "passage_id")

    @cached_property
    def published(self) -> DataFrame:
        return published_passages(self.passages, self.works)

    @cached_property
    def unnumbered_published(self) -> DataFrame:
        return published_passages(self.unnumbered_passages, self.works)

    @property
    def index(self) -> LexicalIndex:
        """The stored lexical index of the published passages.

        It is built once for a state of the tables it comes from, as a corpus's index is, and searched by every later query.
        """
        state = (self.spark.sparkContext.applicationId, *[files_of(self.spark, f"{self.dir}/{t}.parquet") for t in ("documents", "labels")])
        if state not in _INDEXES:
            _INDEXES[state] = build_index(self.unnumbered_published, keep=True)  # it needs no numbers
        return _INDEXES[state]

    @cached_property
    def verses(self) -> DataFrame:
        i = F.col("item_id")
        return self.table("benchmark").select(
            "item_id", (i % 5 + 1).alias("chapter"), (F.floor(i / 5) + 1).alias("verse"), "text"
        )

    @cached_property
    def alignments(self) -> DataFrame:
        d = F.col("doc_id")
        start = F.floor(d / 5) % 8 + 1
        return self.table("documents").select(
            d.alias("passage_id"), (d % 5 + 1).alias("chapter"), start.alias("verse_start"),
            F.least(F.lit(8), start + d % 3).alias("verse_end"),
        )

    @cached_property
    def queries(self) -> DataFrame:
        return self.table("conversations").filter("role = 'user'").select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text"
        )

    @cached_property
    def query_refs(self) -> DataFrame:
        q = F.col("query_id")
        return self.queries.select(
            "query_id", (q % 5 + 1).alias("chapter"), (q % 8 + 1).alias("verse_start"),
            F.least(F.lit(8), q % 8 + 1 + q % 2).alias("verse_end"),
        )

    @cached_property
    def translations(self) -> DataFrame:
        return self.table("conversations").filter("role <> 'user'").select(
            F.col("conv_id").alias("passage_id"), F.lit("en").alias("language"), "text",
            F.when(F.col("role") == "system", "HUMAN").otherwise("MACHINE").alias("translator_kind"),
            F.concat(F.lit("t"), F.col("turn").cast("string")).alias("translator_name"),
            F.when(F.col("turn") % 2 == 0, "VERIFIED").otherwise("MACHINE_PROPOSED")
            .alias("verification_status"),
        )

    @cached_property
    def scan_pages(self) -> DataFrame:
        p = F.col("page_id")
        return self.table("pages").select(
            "page_id", (p % 4).alias("source_id"), F.floor(p / 4).alias("image_index"),
            F.col("url").alias("image_uri"),
            F.when(p % 3 == 1, "").when(p % 3 == 2, F.col("url")).alias("ocr_raw_text"),
            F.when(p % 3 == 2, (p % 100) / F.lit(100.0)).alias("ocr_confidence"),
        )

    @cached_property
    def quoting(self) -> DataFrame:
        """Passages by verse; two in three open by quoting a span of the verse."""
        words = verse_words(self.verses)
        rows = passages_by_verse(self.alignments, self.unnumbered_passages).join(words, ["chapter", "verse"])
        step = F.floor(F.col("passage_id") / 40)
        span = F.slice("words", (1 + step % 4 * 5).cast("int"), (4 + F.floor(F.col("passage_id") / 160) % 2).cast("int"))
        quoted = F.concat(F.lit("\ufd3f"), F.array_join(span, " "), F.lit("\ufd3e "), F.col("raw_text"))
        return rows.select(
            "passage_id", "chapter", "verse",
            F.when(F.col("passage_id") % 3 != 0, quoted).otherwise(F.col("raw_text")).alias("raw_text"),
        )

    @cached_property
    def scripted(self) -> DataFrame:
        t = F.lower("text")
        return self.documents.select(
            "doc_id", "lang",
            F.when(F.col("lang") == "fr", F.translate(t, LATIN, AS_ARABIC))
            .when(F.col("lang") == "de", F.translate(t, LATIN, AS_VOWELLED))
            .when(F.col("lang") == "es", F.translate(t, LATIN, AS_URDU))
            .otherwise(F.col("text")).alias("text"),
        )

    def any_word_queries(self) -> DataFrame:
        """Search text of each user turn: any of its words."""
        return self.queries.select("query_id", F.array_join(turn_words(), " OR ").alias("text"))

    def turn_queries(self) -> DataFrame:
        """Search text of each user turn, all its words in it.

        Most ask for any word. Every eighth asks for its first two words as a phrase, every eighth for the
        first without the second, every eighth for both, or else for all the rest.
        """
        w, q = turn_words(), F.col("query_id") % 8
        first, second = F.element_at(w, 1), F.element_at(w, 2)
        rest = F.concat(F.lit(" OR "), F.array_join(F.slice(w, F.lit(3), F.size(w)), " "))
        text = (
            F.when((F.size(w) < 3) | ~q.isin(1, 3, 5), F.array_join(w, " OR "))
            .when(q == 1, F.concat(F.lit('"'), first, F.lit(" "), second, F.lit('"'), rest))
            .when(q == 3, F.concat(first, F.lit(" -"), second, rest))
            .otherwise(F.concat(first, F.lit(" "), second, rest))
        )
        return self.queries.select("query_id", text.alias("text"))


def turn_words():
    """Distinct words of a turn in order; the operator word is none of them."""
    return F.array_distinct(F.filter(search_tokens("text"), lambda w: w != "or"))
