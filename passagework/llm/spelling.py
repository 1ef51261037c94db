"""Spelling variants of a vocabulary, by asymmetric chunks.

Of two words that differ by one inserted, deleted or replaced code point, the shorter one (of equally long ones, either)
contributes two disjoint chunks, its halves. One edit spares one of them, and the other word holds that chunk as a
positional gram: in its old place if the edit comes behind it, moved by the difference in length, one at most, if the
edit comes before. So of the other word's positional grams only those within that shift can join, and only those are
written. A chunk that too many words share is split: inside it the rest of the word again has two halves of which one
is spared, and so on, until a group can only differ in one place. Candidates are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import CHUNK_BYTES, chunks, mapped
from passagework.session import materialise

#: Runs of ASCII letters and of U+00C0 to U+00FF in lower-cased UTF-8.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: ASCII that is in no run: a text may be cut there.
BREAK = re.compile(rb"[\x00-\x60\x7b-\x7f]")
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Candidate pairs of one chunk beyond which it is split.
GROUP_PAIRS = 10_000


def stretches(text: bytes, limit: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The text in pieces of about `limit` bytes, cut where no run is."""
    start = 0
    while len(text) - start > limit:
        cut = BREAK.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def word_counts(docs: DataFrame, *, min_length: int = 6, drop_every: int | None = None) -> DataFrame:
    """(word, n): how often each lower-cased run of at least `min_length` code points stands in the whole texts.

    Only A-Z are lower-cased. With `drop_every`, misspellings are planted first: where crc32 of `<doc_id>:<run>` is
    divisible by it, the run loses its code point at that crc32 modulo its length; a null doc_id counts as the empty
    text. Null and empty texts have no words; repeated rows count again; a very long text is read in pieces; an empty
    table gives no rows; columns other than doc_id and text are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
            )
            held.clear()
            return made

        for b in chunks(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                before = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
                for part in stretches((text or "").encode("utf-8", "replace").lower()):
                    for run, n in Counter(RUN.findall(part)).items():
                        length = len(run) - run.count(0xC3)
                        if length < min_length:
                            continue
                        if drop_every is not None:
                            h = zlib.crc32(run, before)
                            if h % drop_every == 0:
                                if length == min_length:
                                    continue
                                plain, at = run.decode(), h % length
                                run = (plain[:at] + plain[at + 1 :]).encode()
                        held[run] += n
                if len(held) > HELD_WORDS:
                    yield batch()
        yield batch()

    return docs.select("doc_id", "text").transform(mapped, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def chunk_key(rows: DataFrame) -> DataFrame:
    """Add `key`: what a word shows outside the region [lo, hi) of the shorter word of a pair."""
    beyond = F.col("hi") + F.when(F.col("role") == "gram", F.col("longer")).otherwise(0)
    return rows.withColumn(
        "key",
        F.xxhash64(
            "longer", "own", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", beyond + 1, F.char_length("word"))
        ),
    )


def halved(rows: DataFrame) -> DataFrame:
    """Each row's region cut into halves: an edit lies in one of them, so what surrounds it is spared."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
    return chunk_key(rows.withColumn("half", F.explode(halves)).select("word", "n", "role", "longer", "own", "half.lo", "half.hi"))


def near_pairs(words: DataFrame, *, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """Distinct (a, n_a, b, n_b): all pairs of the distinct words (word, n) that are one edit of one code point apart."""
    length = F.char_length("word")
    places = F.array(
        # Words of one length meet as chunk and gram at once.
        F.struct(F.lit("both").alias("role"), F.lit(0).alias("longer"), length.alias("own")),
        F.struct(F.lit("chunk").alias("role"), F.lit(1).alias("longer"), length.alias("own")),
        F.struct(F.lit("gram").alias("role"), F.lit(1).alias("longer"), (length - 1).alias("own")),
    )
    whole = words.select("word", "n", F.explode(places).alias("place")).select("word", "n", "place.*")
    rows = halved(whole.withColumn("lo", F.lit(0)).withColumn("hi", F.col("own")))
    found: list[DataFrame] = []
    while True:
        rows = materialise(rows)
        sizes = rows.groupBy("key").agg(
            F.sum((F.col("role") != "gram").cast("long")).alias("chunks"), F.sum((F.col("role") != "chunk").cast("long")).alias("grams"),
            F.max(F.col("hi") - F.col("lo")).alias("width"),
        )
        # A region of one code point leaves no more words than there are letters to put in.
        hot = materialise(sizes.where((F.col("chunks") * F.col("grams") > group_pairs) & (F.col("width") > 1)).select("key"))
        crowded = not hot.isEmpty()
        kept = rows.join(hot, "key", "left_anti") if crowded else rows
        a = kept.where("role <> 'gram'").select("key", "longer", F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = kept.where("role <> 'chunk'").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
        met = a.join(b, "key").where("longer = 1 or a < b")
        found.append(materialise(met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")))
        if not crowded:
            break
        rows = halved(rows.join(hot, "key", "left_semi").drop("key"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.dropDuplicates(["a", "b"])


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root): where following `links` (word, form) from each linked word ends. Forms must not run in circles."""
    reached = materialise(links.select("word", F.col("form").alias("root")))
    while True:
        step = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        # Each round doubles the distance: as many rounds as the logarithm of the longest chain.
        moved = materialise(reached.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")))
        reached = moved.select("word", "root")
        if moved.where("went").isEmpty():
            return reached


def spelling_variants(words: DataFrame, *, ratio: int = 5, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """word, n, n_near, form, form_n, root of each row of the distinct `words` (word, n).

    n_near counts the words one edit away. `form` is the one of largest n among them (ties: smallest in code-point
    order) if that n is at least `ratio` times the word's own, else null; `root` is the last of the forms followed from
    the word, the word itself where it has none. An empty table gives no rows; further columns are not read.
    """
    words = words.select("word", "n")
    pairs = materialise(near_pairs(words, group_pairs=group_pairs))
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    )
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    strong = -F.col("best.m") >= ratio * F.col("n")
    told = materialise(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"),
        )
    )
    roots = last_forms(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
