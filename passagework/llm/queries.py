"""The registered queries of these operators over the driver tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.common import table
from passagework.llm.decontamination import contamination
from passagework.llm.embeddings import near_vectors
from passagework.llm.jaccard import similar_documents
from passagework.llm.language import fit as fit_languages
from passagework.llm.language import held_out, identify
from passagework.llm.mixing import mix_sources
from passagework.llm.personal_data import find_personal_data
from passagework.llm.personal_data import fit as fit_personal_data
from passagework.llm.phrases import remove_repeated_phrases
from passagework.llm.pieces import encode_pieces, piece_digests
from passagework.llm.repair import damage, repair_digests
from passagework.llm.sharding import shard_documents
from passagework.llm.spelling import spelling_variants, word_counts
from passagework.llm.suffixes import remove_repeated_strings
from passagework.llm.token_files import token_digests, write_documents
from passagework.session import materialise, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(f):
    QUERIES[f.__name__] = f
    return f


@registered
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


ORACLES["op1_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.y FROM reach r JOIN linked l ON l.x = r.other
)
SELECT e.vec_id, (SELECT count(*) FROM linked l WHERE l.x = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = e.vec_id
"""


@registered
def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_digests(encode_pieces(table(spark, sf_dir, "documents"), model, decode=True))


@registered
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out()))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@registered
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_digests(spark, path)


@registered
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_documents(table(spark, sf_dir, "documents"), length=5, threshold=0.8)
    return found.select("doc_id", "class_id", "n_links", "kept")


ORACLES["op5_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0) x
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS (SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE k / (a.n + b.n - k) >= 0.8),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.y FROM reach r JOIN linked l ON l.x = r.other)
SELECT d.doc_id, c.class_id, (SELECT count(*) FROM linked l WHERE l.x = d.doc_id) AS n_links, d.doc_id = c.class_id AS kept
FROM d JOIN (SELECT id, min(other) AS class_id FROM reach GROUP BY id) c ON c.id = d.doc_id
"""


@registered
def op6_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_phrases(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op6_repeated_phrases"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35) x
), again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN again USING (h)),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""


@registered
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_strings(table(spark, sf_dir, "documents"), window=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op7_suffix_dedup"] = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents
), spot AS (SELECT doc_id, x, unnest(range(n - 99)) AS i FROM d WHERE n >= 100),
win AS (SELECT doc_id, i, md5(substr(x, CAST(2 * i + 1 AS BIGINT), 200)) AS h FROM spot),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS p FROM later),
byte AS (SELECT doc_id, x, unnest(range(n)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(substr(x, CAST(2 * p + 1 AS BIGINT), 2), '' ORDER BY p) AS x FROM byte ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), lost AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE fresh) AS spans FROM (
    SELECT doc_id, p - lag(p, 1, -9) OVER (PARTITION BY doc_id ORDER BY p) > 1 AS fresh FROM gone) y GROUP BY doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(lost.spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.x, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""


@registered
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLES["op8_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), spots AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS phrase FROM spots
), sizes AS (SELECT DISTINCT n FROM win),
spot AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n
), found AS (
  SELECT s.doc_id, win.item_id, s.i, s.n FROM spot s JOIN win
  ON win.n = s.n AND win.phrase = list_aggregate(s.w[s.i:s.i + s.n - 1], 'string_agg', ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) x GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) x GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""


@registered
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, fit_personal_data(docs))


@registered
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "byte_start"
    )


ORACLES["op10_sharding"] = r"""
WITH codes AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c
    FROM (SELECT unnest(range(256)) AS i) x) y
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), rows AS (
  SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: CAST('0x' || substr(h, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, codes
), sums AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY doc_id) AS BIGINT) - size AS byte_start, CAST(sum(size) OVER () AS BIGINT) AS total FROM rows
), placed AS (
  SELECT *, CAST(least(23, (24 * (2 * byte_start + size)) // (2 * total)) AS INTEGER) AS shard FROM sums
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, byte_start
FROM placed
"""


@registered
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return repair_digests(given, damage(given))


#: DuckDB: the table of crc32, and the crc32 of the bytes of a hexadecimal string `h`.
CRC_TABLE = """
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c
    FROM (SELECT unnest(range(256)) AS i) x) y
"""
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: CAST('0x' || substr(h, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""

ORACLES["op11_conversation_repair"] = f"""
WITH RECURSIVE codes AS ({CRC_TABLE}), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations
), hit AS (SELECT conv_id, turn, role, text, {CRC} % 20 AS f FROM given, codes
), damaged AS (
  SELECT conv_id, coalesce('=' || conv_id, '') AS k, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS again
  FROM hit WHERE f <> 0
), numbered AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS told, left(role, 1) AS init,
    row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), seen AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again2 FROM numbered
), faulty AS (
  SELECT k, turn, role, text, init, i, told = '' AS blank, told <> '' AND again2 AS dup,
    told <> '' AND NOT again2 AND right(told, 1) NOT IN ('.', '!', '?') AS cut, lag(init) OVER (PARTITION BY k ORDER BY i) || init AS pair FROM seen
), counts AS (
  SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (dup) AS dup, count(*) FILTER (cut) AS cut, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY k
), chain(q, q1, cost, letters, lines) AS (
  VALUES ('0', '0', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
    ('0', 'u', 2, 'I', chr(10) || 'user:'), ('s', 'u', 2, 'I', chr(10) || 'user:'), ('a', 'u', 2, 'I', chr(10) || 'user:'), ('u', 'a', 2, 'I', chr(10) || 'assistant:'),
    ('0', 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), act(letter, q, init, q2, cost, role) AS (
  VALUES ('D', '0', NULL, '0', 3, NULL), ('D', 's', NULL, 's', 3, NULL), ('D', 'u', NULL, 'u', 3, NULL), ('D', 'a', NULL, 'a', 3, NULL),
    ('K', '0', 's', 's', 0, NULL), ('K', '0', 'u', 'u', 0, NULL), ('K', 's', 'u', 'u', 0, NULL), ('K', 'a', 'u', 'u', 0, NULL), ('K', 'u', 'a', 'a', 0, NULL),
    ('R', '0', NULL, 'u', 2, 'user'), ('R', 's', NULL, 'u', 2, 'user'), ('R', 'a', NULL, 'u', 2, 'user'), ('R', 'u', NULL, 'a', 2, 'assistant')
), way AS (
  SELECT k, CAST(0 AS BIGINT) AS i, '0' AS q, {{'c': 0, 'a': '', 'r': ''}} AS best FROM counts
  UNION ALL
  SELECT w.k, w.i + 1, act.q2, min({{'c': w.best.c + chain.cost + act.cost + CASE WHEN act.letter <> 'D' AND f.cut THEN 1 ELSE 0 END,
    'a': w.best.a || chain.letters || act.letter,
    'r': w.best.r || chain.lines || CASE WHEN act.letter = 'D' THEN '' ELSE chr(10) || coalesce(act.role, f.role) || ':' || f.text END}})
  FROM way w JOIN faulty f ON f.k = w.k AND f.i = w.i + 1 JOIN chain ON chain.q = w.q JOIN act ON act.q = chain.q1
  WHERE act.letter = 'D' OR (NOT f.blank AND NOT f.dup AND (act.letter = 'R' OR act.init = f.init))
  GROUP BY w.k, w.i, act.q2
), done AS (
  SELECT w.k, min({{'c': w.best.c + chain.cost, 'a': w.best.a || chain.letters, 'r': w.best.r || chain.lines}}) AS best
  FROM way w JOIN counts n ON n.k = w.k AND n.n = w.i JOIN chain ON chain.q = w.q WHERE chain.q1 IN ('0', 'a') GROUP BY w.k
)
SELECT g.conv_id, CAST(coalesce(n.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(n.blank, 0) AS BIGINT) AS blank, CAST(coalesce(n.dup, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(n.cut, 0) AS BIGINT) AS truncated, CAST(coalesce(n.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(d.best.c, 0) AS BIGINT) AS cost,
  coalesce(d.best.a, '') AS audit, sha256(coalesce(substr(d.best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS k FROM conversations) g LEFT JOIN counts n USING (k) LEFT JOIN done d USING (k)
"""


@registered
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@registered
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(table(spark, sf_dir, "documents"), drop_every=199)
    return spelling_variants(materialise(words.where("n >= 5"))).select("word", "form", "root", "n", "n_near", "form_n")


ORACLES["op13_spelling_variants"] = rf"""
WITH RECURSIVE codes AS ({CRC_TABLE}), run AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
    FROM documents) x WHERE length(run) >= 6 GROUP BY doc_id, run
), coded AS (SELECT run, n, {CRC} AS c, length(run) AS len FROM run, codes
), said AS (SELECT n, CASE WHEN c % 199 = 0 THEN left(run, CAST(c % len AS BIGINT)) || substr(run, CAST(c % len + 2 AS BIGINT)) ELSE run END AS word FROM coded
), words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), short AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) x
), met AS (
  SELECT a.word, b.word AS other, b.n AS m FROM short a JOIN short b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT b.word, a.word, a.n FROM short a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM short a JOIN words b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, min({{'m': -m, 'other': other}}) AS top FROM met GROUP BY word
), told AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.m >= 5 * w.n THEN top.other END AS form, CASE WHEN -top.m >= 5 * w.n THEN -top.m END AS form_n
  FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS here, 0 AS steps FROM told UNION ALL SELECT walk.word, told.form, steps + 1 FROM walk JOIN told ON told.word = walk.here WHERE told.form IS NOT NULL
), root AS (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM told JOIN root USING (word)
"""
