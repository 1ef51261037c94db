"""Lexical search over a stored index of positional postings, for whole tables of queries.

Passages are dealt into shards of like length and numbered inside them; the postings of one term in one shard are a
block, one row: its greatest term frequency and least length, which bound what it can add to a score, and its entries
(place, tf, positions). Blocks lie in a folder by hash of the term, so a batch of searches reads the folders of its own
terms. Queries are dealt into tiles; a task keeps the best places of its tile's queries and streams its shards through
them, short passages first: a query skips shards that cannot reach its last place, and inside a shard looks its commoner
words up only for passages that its rarer ones leave in reach. Required words, exclusions, phrases (adjacent positions)
and limits are sets of places of the same shard, so what fulfils a branch is never written out; no text takes part.

An index is a list of segments. Replacing works adds one segment and marks what is gone in the older ones, with
counts of what the marks take away from each term, so nothing is rewritten until segments are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators.tables import bounded
from passagework.session import materialise, release_table

#: Folders of a segment's postings, by hash of the term.
POSTING_BUCKETS = 64
#: Passages of one shard, and queries whose best places one task keeps.
SHARD_ROWS = 8_192
TILE_QUERIES = 131_072
#: Words of one shard, about: its blocks are made in one task's memory.
SHARD_TOKENS = 4_000_000
#: Tasks of a build for each core, where the shards are as many.
TASKS_PER_CORE = 2
#: Queries of a tile that are met with a shard at once.
MET_QUERIES = 4_096
#: Queries whose scores over a shard are held at once.
SUMMED_QUERIES = 32
#: Terms in more than one of so many passages of a shard are held as a row of gains, one for each passage, the commonest
#: first and in so many numbers at most.
ROW_SHARE, ROW_CELLS = 16, 10_000_000
#: Words of a query that can add so much of its last place's score in all, and not more, are looked up last.
LATER = 0.3
#: Scores are compared after rounding to six places.
ROUNDING = 1e-5
#: A passage without any of the words scores nothing, others more.
_LEAST = 5e-324


def search_tokens(matching: Column | str, *, stem: bool = False) -> Column:
    """Lower-case letter and digit runs of a matching form."""
    c = F.col(matching) if isinstance(matching, str) else matching
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    if not stem:
        return tokens
    prefix = rf"^(?:{'|'.join(T.V.CLITICS)})(?=.{{3,}})"
    return F.transform(tokens, lambda w: F.regexp_replace(w, prefix, ""))


def _bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(POSTING_BUCKETS)).cast("int")


# --------------------------------------------------------------------------
# The index
# --------------------------------------------------------------------------

@dataclass(frozen=True)
class Segment:
    """Stored tables of the passages that came in together, and what has gone since."""

    facts: DataFrame  # passage_id, work_slug, n_tokens, shard, place
    postings: DataFrame  # term, shard, n, max_tf, min_tokens, entries (place, tf, positions); in folders by bucket
    gone: DataFrame | None = None  # passage_id, shard, place
    lost: DataFrame | None = None  # term, n: postings of passages that are gone


@dataclass(frozen=True)
class LexicalIndex:
    """Segments, the first the oldest, and the number and total length of the passages that count."""

    segments: tuple[Segment, ...]
    n: int
    n_tokens: int

    def facts(self) -> DataFrame:
        """passage_id, work_slug, n_tokens, shard (of the whole index), place of every passage."""
        return _union([_kept(s.facts, s).withColumn("shard", _global(i)) for i, s in enumerate(self.segments)])

    def read(self, terms: DataFrame, *columns: str | Column) -> DataFrame:
        """`columns` of the blocks of `terms` (term, bucket and more), from their folders only; what is gone is still in the entries."""
        asked = [r.bucket for r in terms.select("bucket").distinct().collect()]  # POSTING_BUCKETS at most
        parts = [s.postings.filter(F.col("bucket").isin(asked)).withColumn("shard", _global(i)).drop("bucket") for i, s in enumerate(self.segments)]
        return _union(parts).join(terms.drop("bucket"), "term").select(*columns)

    def heads(self, terms: DataFrame) -> DataFrame:
        """term, shard, n, max_tf, min_tokens of the blocks of `terms` (term, bucket)."""
        return self.read(terms.select("term", "bucket"), "term", "shard", "n", "max_tf", "min_tokens")

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """term, df: passages that hold each of `terms`; one in no passage has no row."""
        counted = self.heads(terms).select("term", "n")
        for s in self.segments:
            if s.lost is not None:
                counted = counted.unionByName(s.lost.join(terms.select("term"), "term", "left_semi").select("term", (-F.col("n")).alias("n")))
        return counted.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")


def _global(segment: int) -> Column:
    return F.col("shard") + F.lit(segment << 40)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _kept(rows: DataFrame, segment: Segment) -> DataFrame:
    return rows if segment.gone is None else rows.join(segment.gone.select("passage_id"), "passage_id", "left_anti")


def _blocks(postings: DataFrame) -> DataFrame:
    """One row for each term of each shard, of rows (bucket, shard, term, place, tf, positions, n_tokens)."""
    return postings.repartition("bucket", "shard").groupBy("bucket", "shard", "term").agg(
        F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("n_tokens").alias("min_tokens"),
        F.array_sort(F.collect_list(F.struct("place", "tf", "positions"))).alias("entries"),
    )


def build_index(
    passages: DataFrame, text: str = "raw_text", *, stem: bool = False, shard_rows: int = SHARD_ROWS, keep: bool = False
) -> LexicalIndex:
    """Index of `passages` (passage_id, work_slug and a text): read once, in one segment.

    With `keep`, the stored tables outlive `release_tables`: they are the corpus's, not one job's.
    """
    segment, n, n_tokens = _segment(passages, text, stem, shard_rows, keep)
    return LexicalIndex((segment,), n, n_tokens)


def _segment(passages: DataFrame, text: str, stem: bool, shard_rows: int, keep: bool) -> tuple[Segment, int, int]:
    words = search_tokens(T.matching_form(text), stem=stem)
    tokens = materialise(
        passages.select("passage_id", "work_slug", words.alias("tokens"))
        .select("passage_id", "work_slug", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("words"))
    )
    total = tokens.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")).first()
    # Passages of like length share a shard, so that its least length says something; small tables still use every core.
    cores = tokens.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, -(-total.n // shard_rows), min(cores, -(-total.n // 512)))
    placed, shards = _sharded(tokens, ranges)
    # Only texts move, once and to the task of their shard, which writes its blocks: no single word is ever shuffled.
    tasks = max(1, min(shards, TASKS_PER_CORE * cores))
    order = Window.partitionBy("shard").orderBy("n_tokens", "passage_id")
    facts = materialise(
        placed.select("passage_id", "work_slug", "n_tokens", "shard").withColumn("place", (F.row_number().over(order) - 1).cast("int")), keep=keep
    )
    by_shard = placed.select("shard", "n_tokens", "passage_id", "words").repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int"))
    blocks = by_shard.sortWithinPartitions("shard", "n_tokens", "passage_id").drop("passage_id").mapInArrow(_blocks_of_shards, _BLOCK_SCHEMA)
    segment = Segment(facts, materialise(blocks.withColumn("bucket", _bucket()), ("bucket",), keep=keep))
    release_table(tokens)
    return segment, total.n, total.n_tokens


def _sharded(tokens: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """`tokens` (passage_id, n_tokens and more) with its shard, and the number of shards.

    Shards are ranges of (n_tokens, passage_id) of like many passages; one of more than SHARD_TOKENS words is dealt into several by hash.
    """
    first = F.struct("n_tokens", "passage_id")
    found = (
        tokens.select("n_tokens", "passage_id").repartitionByRange(ranges, "n_tokens", "passage_id")
        .groupBy(F.spark_partition_id().alias("range")).agg(F.min(first).alias("first"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    )
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / SHARD_TOKENS)).cast("long").alias("pieces")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    marks = materialise(found.select("range", "first", pieces).withColumn("base", F.coalesce(F.sum("pieces").over(before), F.lit(0))))
    shards = marks.agg(F.sum("pieces")).first()[0] or 1
    table = marks.agg(F.array_sort(F.collect_list(F.struct("first", "base", "pieces"))).alias("_marks"))
    own = F.element_at(F.filter("_marks", lambda m: m["first"] <= first), -1)
    dealt = tokens.crossJoin(F.broadcast(table)).withColumn("_own", own).drop("_marks")
    shard = F.col("_own.base") + F.pmod(F.xxhash64("passage_id"), F.col("_own.pieces"))
    return dealt.withColumn("shard", shard).drop("_own"), shards


_BLOCK_SCHEMA = (
    "term string, shard bigint, n bigint, max_tf int, min_tokens bigint, entries array<struct<place: int, tf: int, positions: array<int>>>"
)


def _blocks_of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (shard, n_tokens, words) sorted by shard; the turn of a row in its shard is its place."""
    now, waiting = None, []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
        for a, z in zip([0, *cuts], [*cuts, len(shard)], strict=True):
            if a == z:
                continue
            if now is not None and now != shard[a]:
                yield from _shard_blocks(now, pa.Table.from_batches(waiting))
                waiting = []
            now = shard[a]
            waiting.append(batch.slice(a, z - a))
    if waiting:
        yield from _shard_blocks(now, pa.Table.from_batches(waiting))


def _shard_blocks(shard: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    words = pc.fill_null(rows.column("words").combine_chunks(), "")
    lengths = pc.fill_null(rows.column("n_tokens"), 0).to_numpy()
    filled = np.flatnonzero(pc.not_equal(words, "").to_numpy(zero_copy_only=False)).astype(np.int32)
    if not len(filled):
        return
    lists = pc.split_pattern(words.take(pa.array(filled)), " ")
    sizes = pc.list_value_length(lists).to_numpy()
    known = pc.list_flatten(lists).dictionary_encode()
    codes = known.indices.to_numpy()
    # Words stand by place and position; a stable sort by term keeps them so.
    order = np.argsort(codes, kind="stable")
    positions = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)[order]
    codes, places = codes[order], np.repeat(filled, sizes)[order]
    entry = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (places[1:] != places[:-1])))
    places, codes = places[entry], codes[entry]
    block = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    spots, starts = np.append(entry, len(positions)), np.append(block, len(entry))
    tf = np.diff(spots).astype(np.int32)
    entries = pa.StructArray.from_arrays(
        [pa.array(places), pa.array(tf), pa.ListArray.from_arrays(pa.array(spots.astype(np.int32)), pa.array(positions))], ["place", "tf", "positions"]
    )
    out = pa.RecordBatch.from_arrays(
        [
            known.dictionary.take(pa.array(codes[block])), pa.array(np.full(len(block), shard, dtype=np.int64)), pa.array(np.diff(starts).astype(np.int64)),
            pa.array(np.maximum.reduceat(tf, block)), pa.array(np.minimum.reduceat(lengths[places], block).astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), entries),
        ],
        names=["term", "shard", "n", "max_tf", "min_tokens", "entries"],
    )
    for at in range(0, len(block), 2_000):
        yield out.slice(at, 2_000)


def replace_works(
    index: LexicalIndex, passages: DataFrame, text: str = "raw_text", *, works: DataFrame | None = None, stem: bool = False, shard_rows: int = SHARD_ROWS
) -> LexicalIndex:
    """The index after all passages of some works are replaced by `passages`.

    Replaced are the works of `passages` and those of `works` (work_slug), which so may also only be removed. Only the new
    passages are read; of the older ones, the postings of what is gone are counted by term.
    """
    named = passages.select("work_slug") if works is None else passages.select("work_slug").union(works.select("work_slug"))
    named = materialise(named.distinct())
    new, n, n_tokens = _segment(passages, text, stem, shard_rows, False)
    old: list[Segment] = []
    n, n_tokens = index.n + n, index.n_tokens + n_tokens
    for s in index.segments:
        left = materialise(_kept(s.facts, s).join(named, "work_slug", "left_semi").select("passage_id", "n_tokens", "shard", "place"))
        taken = left.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")).first()
        if not taken.n:
            old.append(s)
            continue
        # Counted inside each block, so no posting moves.
        marks = left.groupBy("shard").agg(F.collect_list("place").alias("left"))
        held = F.size(F.array_intersect(F.col("entries.place"), F.col("left"))).cast("long")
        fewer = s.postings.join(marks, "shard").select("term", held.alias("n")).filter("n > 0").groupBy("term").agg(F.sum("n").alias("n"))
        gone = left.select("passage_id", "shard", "place")
        if s.gone is not None:
            gone, fewer = gone.unionByName(s.gone), fewer.unionByName(s.lost).groupBy("term").agg(F.sum("n").alias("n"))
        old.append(replace(s, gone=materialise(gone), lost=materialise(fewer)))
        n, n_tokens = n - taken.n, n_tokens - taken.n_tokens
    return LexicalIndex((*old, new), n, n_tokens)


def merge_segments(index: LexicalIndex) -> LexicalIndex:
    """The same index in one segment, without what is gone. Texts are not read; blocks keep their shards."""
    facts = materialise(index.facts())
    parts = [s.postings.withColumn("shard", _global(i)) for i, s in enumerate(index.segments)]
    entries = _union(parts).select("bucket", "shard", "term", F.explode("entries").alias("e")).select("bucket", "shard", "term", "e.*")
    postings = materialise(_blocks(entries.join(facts.select("shard", "place", "n_tokens"), ["shard", "place"])), ("bucket",))
    return LexicalIndex((Segment(facts, postings),), index.n, index.n_tokens)


# --------------------------------------------------------------------------
# Searches
# --------------------------------------------------------------------------

def parse_search(queries: DataFrame, text: str = "text", *, stem: bool = False) -> DataFrame:
    """One row per OR branch: required terms, phrases (arrays of terms) and excluded terms.

    Words are all required, "..." is a phrase, - excludes, OR separates branches.
    """
    branch, item_mark = "\x01", "\x02"
    items = F.regexp_extract_all(T.matching_form(text), F.lit(r'-?"[^"]*"|[^ ]+'), F.lit(0))
    marked = F.array_join(
        F.transform(items, lambda i: F.when(F.lower(i) == "or", branch).otherwise(i)), item_mark
    )
    out = T.unnest(queries, ["query_id"], F.split(marked, branch), "_branch", "branch")
    parts = F.filter(F.split("_branch", item_mark), lambda i: i != "")
    out = out.withColumn("_parts", parts)

    def tokens_of(keep) -> Column:
        return F.array_distinct(
            F.flatten(F.transform(F.filter("_parts", keep), lambda i: search_tokens(i, stem=stem)))
        )

    phrases = F.filter(
        F.transform(F.filter("_parts", lambda i: i.startswith('"')), lambda i: search_tokens(i, stem=stem)),
        lambda p: F.size(p) > 1,
    )
    return out.select(
        "query_id", "branch",
        tokens_of(lambda i: ~i.startswith("-")).alias("terms"),
        tokens_of(lambda i: i.startswith("-")).alias("excluded"),
        phrases.alias("phrases"),
    ).filter(F.size("terms") > 0)


@dataclass(frozen=True)
class Scale:
    """BM25 over an index: a term's weight times what a posting makes of it."""

    n: int
    mean: float
    k1: float
    b: float

    def weight(self) -> Column:
        return F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))

    def share(self, tf: str, n_tokens: str) -> Column:
        norm = F.col(tf) + self.k1 * (1 - self.b + self.b * F.col(n_tokens) / self.mean)
        return F.col(tf) * (self.k1 + 1) / norm


def _place(chapter: str = "chapter", verse: str = "verse") -> Column:
    return F.concat_ws(":", F.lit("v"), F.col(chapter).cast("string"), F.col(verse).cast("string"))


def _limits(query_refs: DataFrame | None, query_works: DataFrame | None) -> DataFrame | None:
    """(query_id, kind, tag): a result must have a tag of each kind its query has. A query with an empty list of works finds nothing."""
    limits = None
    if query_refs is not None:
        verses = query_refs.withColumn("verse", F.explode(F.sequence("verse_start", "verse_end")))
        limits = verses.select("query_id", F.lit(1).alias("kind"), _place().alias("tag"))
    if query_works is not None:
        tags = F.transform("works", lambda w: F.concat(F.lit("w:"), w))
        named = query_works.filter("works is not null").select("query_id", F.lit(2).alias("kind"), F.explode_outer(tags).alias("tag"))
        limits = named if limits is None else limits.unionByName(named)
    return None if limits is None else limits.distinct()


def _tags(index: LexicalIndex, limits: DataFrame, alignments: DataFrame | None, works: bool) -> DataFrame:
    """(tag, shard, place) of the tags that some query asks for."""
    facts = index.facts()
    tags = facts.select(F.concat(F.lit("w:"), "work_slug").alias("tag"), "shard", "place") if works else None
    if alignments is not None:
        verses = alignments.withColumn("verse", F.explode(F.sequence("verse_start", "verse_end")))
        placed = verses.select("passage_id", _place().alias("tag")).distinct().join(facts.select("passage_id", "shard", "place"), "passage_id")
        tags = placed.drop("passage_id") if tags is None else tags.unionByName(placed.drop("passage_id"))
    return tags.join(limits.select("tag").distinct(), "tag", "left_semi")


def search(
    queries: DataFrame,
    index: LexicalIndex,
    *,
    text: str = "text",
    query_refs: DataFrame | None = None,
    alignments: DataFrame | None = None,
    query_works: DataFrame | None = None,
    limit: int = 100,
    k1: float = 1.2,
    b: float = 0.75,
    stem: bool = False,
) -> DataFrame:
    """Boolean search ranked by BM25: query_id, passage_id, work_slug, score, rank. Exact.

    A query with ranges finds passages on its verses only, one with works those of its works only.
    """
    every = materialise(parse_search(queries, text, stem=stem))
    said = every.select(F.explode(F.flatten("phrases")).alias("term"), F.lit(True).alias("spoken"))
    asked = every.select(F.explode(F.concat("terms", "excluded")).alias("term"), F.lit(False).alias("spoken")).unionByName(said)
    asked = asked.groupBy("term").agg(F.max("spoken").alias("spoken"))
    vocabulary = bounded(materialise(asked.select("term", _bucket().alias("bucket"), _number("term").alias("tid"), "spoken")), 50_000)
    scale = Scale(index.n, index.n_tokens / index.n if index.n_tokens else 1.0, k1, b)
    frequency = bounded(materialise(index.frequencies(vocabulary).join(vocabulary, "term").withColumn("weight", scale.weight())), 50_000)

    # Every positive term of a query counts, in whatever branch it stands.
    wanted = every.select("query_id", F.explode("terms").alias("term")).groupBy("query_id").agg(F.collect_set(_number("term")).alias("tids"))
    plain_word = (F.size("terms") == 1) & (F.size("excluded") == 0) & (F.size("phrases") == 0)
    numbers = lambda words: F.transform(words, _number)
    branch = F.struct(numbers("terms").alias("need"), numbers("excluded").alias("bar"), F.transform("phrases", numbers).alias("phrases"))
    branches = every.groupBy("query_id").agg(F.when(~F.bool_and(plain_word), F.collect_list(branch)).alias("branches"))
    rows = wanted.join(branches, "query_id")
    # A term's weight goes with its blocks, not with every query that has it; blocks whose numbers are small travel in short ones.
    places, tfs = F.col("entries.place"), F.col("entries.tf")
    short = (F.col("max_tf") < 1 << 7) & (F.element_at(places, -1) < 1 << 15)
    given = index.read(
        frequency, "shard", "tid", "weight", F.when(short, _TERM).otherwise(_LONG_TERM).alias("kind"),
        F.when(short, places.cast("array<smallint>")).alias("short_places"), F.when(short, tfs.cast("array<tinyint>")).alias("short_tfs"),
        F.when(~short, places).alias("places"), F.when(~short, tfs).alias("tfs"),
        F.when(F.col("spoken"), F.flatten("entries.positions")).alias("positions"),
    )
    limits = _limits(query_refs, query_works)
    if limits is None:
        rows = rows.withColumn("limits", F.lit(None).cast("array<array<bigint>>"))
    else:
        limits = materialise(limits)
        tags = _tags(index, limits, alignments if query_refs is not None else None, query_works is not None)
        # A kind whose list is empty lets nothing through.
        number = F.when(F.col("tag").isNotNull(), _number("tag"))
        kinds = limits.groupBy("query_id", "kind").agg(F.collect_list(number).alias("tags"))
        rows = rows.join(kinds.groupBy("query_id").agg(F.collect_list("tags").alias("limits")), "query_id", "left")
        held = tags.groupBy("shard", _number("tag").alias("tid")).agg(F.array_sort(F.collect_set("place")).alias("places"))
        given = given.unionByName(held.withColumn("kind", F.lit(_TAG)), allowMissingColumns=True)
    # A part's best places of a query travel as one row of two lists, and are ranked where they arrive.
    lists = _scored(materialise(rows), index, given, scale, limit).repartition("query_id")
    found = lists.select("query_id", F.inline(F.arrays_zip("ids", "millionths"))).toDF("query_id", "passage_id", "millionths")
    best = _best(found.select("query_id", "passage_id", (F.col("millionths") / 1e6).alias("score")), limit)
    return best.join(index.facts().select("passage_id", "work_slug"), "passage_id").select("query_id", "passage_id", "work_slug", "score", "rank")


def _number(name: Column | str) -> Column:
    """Terms and tags are numbered by hash; a tag holds a colon, a term never."""
    return F.xxhash64(name)


def _best(scored: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "passage_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def shard_bounds(wanted: DataFrame, index: LexicalIndex, vocabulary: DataFrame, scale: Scale) -> DataFrame:
    """(query_id, shard, bound): what a passage of the shard can score at most, from the heads of its blocks."""
    heads = index.heads(vocabulary).select("term", "shard", scale.share("max_tf", "min_tokens").alias("share"))
    return wanted.join(heads, "term").groupBy("query_id", "shard").agg(F.sum(F.col("weight") * F.col("share")).alias("bound"))


#: What a row of a task is, in the order of its stream.
_QUERY, _MEMBERS, _TERM, _LONG_TERM, _TAG = range(5)


def _scored(rows: DataFrame, index: LexicalIndex, given: DataFrame, scale: Scale, limit: int) -> DataFrame:
    """query_id, ids, millionths (of score): the best `limit` passages of each query (query_id, tids, branches, limits) in each part of the shards.

    Every tile of queries meets every shard; a tile's shards are dealt into parts only as far as the cores ask for it, one
    task a core, so blocks are copied once a tile, and queries once a part, where each leaves `limit` rows.
    """
    facts = index.facts()
    member = F.array_sort(F.collect_list(F.struct("place", "passage_id", "n_tokens")))
    members = materialise(
        facts.groupBy("shard").agg(member.alias("m"))
        .select("shard", F.col("m.place").alias("places"), F.col("m.passage_id").alias("ids"), F.col("m.n_tokens").alias("lengths"))
    )
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, -(-rows.count() // TILE_QUERIES))
    parts = max(1, min(members.count(), -(-cores // tiles)))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    tile = F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int")
    asked = rows.withColumns({"kind": F.lit(_QUERY), "shard": F.lit(-1).cast("long"), "_part": every(parts)}).withColumn("task", tile * parts + F.col("_part"))
    part = F.pmod("shard", F.lit(parts)).cast("int")
    met = members.withColumn("kind", F.lit(_MEMBERS)).unionByName(given, allowMissingColumns=True)
    met = met.withColumn("_tile", every(tiles)).withColumn("task", F.col("_tile") * parts + part)
    stream = asked.drop("_part").unionByName(met.drop("_tile"), allowMissingColumns=True)
    types = {f.name: f.dataType.simpleString() for f in [*rows.schema, *facts.schema]}
    # Sent to Python, a row without a list costs as many steps as rows stand before it in its batch; one with an empty list a single step.
    lists = {f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in stream.schema if f.dataType.typeName() == "array"}
    return (
        stream.repartitionById(tiles * parts, "task").sortWithinPartitions("task", "shard", "kind").withColumns(lists)
        .mapInArrow(_best_of_tasks(scale, limit), f"query_id {types['query_id']}, ids array<{types['passage_id']}>, millionths array<bigint>")
    )


def _best_of_tasks(scale: Scale, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile, waiting = None, None, []
        for batch in batches:
            task, shard = batch.column("task").to_numpy(), batch.column("shard").to_numpy()
            cuts = np.flatnonzero((task[1:] != task[:-1]) | (shard[1:] != shard[:-1])) + 1
            for a, z in zip([0, *cuts], [*cuts, len(task)], strict=True):
                if a == z:
                    continue
                if now is not None and now != (task[a], shard[a]):
                    tile = _fold(tile, now, waiting, scale, limit)
                    waiting = []
                    if now[0] != task[a]:
                        yield from tile.results()
                        tile = None
                now = (task[a], shard[a])
                waiting.append(batch.slice(a, z - a))
        if now is not None:
            yield from _fold(tile, now, waiting, scale, limit).results()

    return run


def _fold(tile: _Tile | None, now: tuple, waiting: list[pa.RecordBatch], scale: Scale, limit: int) -> _Tile:
    """The tile after the rows of one shard; its queries come first, as shard -1."""
    rows = pa.Table.from_batches(waiting)
    if now[1] < 0:
        return _Tile(rows, scale, limit)
    tile = _Tile(None, scale, limit) if tile is None else tile
    if tile.n:
        tile.meet(_Shard(rows, scale))
    return tile


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each row's start; a null has none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    values = pc.list_flatten(column).to_numpy()
    return (values.astype(str) if values.dtype == object else values), np.concatenate([[0], np.cumsum(sizes)])


class _Shard:
    """Blocks of one shard: places and gains by term, places by tag, and the passages that still count."""

    def __init__(self, rows: pa.Table, scale: Scale):
        kind = rows.column("kind").to_numpy()
        known, blocks = rows.filter(pa.array(kind == _MEMBERS)), rows.filter(pa.array(kind > _MEMBERS))
        alive, _ = _flat(known.column("places"))
        # Blocks of short numbers come first, so the values of both kinds follow one another.
        (short_places, short), (places, long) = _flat(blocks.column("short_places")), _flat(blocks.column("places"))
        self.start = short + long
        self.places = np.concatenate([short_places, places]).astype(np.intp)  # as numpy indexes
        self.n = int(max(alive.max(initial=-1), self.places.max(initial=-1))) + 1
        ids, _ = _flat(known.column("ids"))
        lengths, _ = _flat(known.column("lengths"))
        self.ids = np.zeros(self.n, dtype=ids.dtype)
        self.ids[alive] = ids
        length, counts = np.ones(self.n), np.zeros(self.n, dtype=bool)
        length[alive], counts[alive] = lengths, True
        # Terms come before tags, which have no frequencies and add nothing.
        self.tfs = np.concatenate([_flat(blocks.column(c))[0].astype(np.int64) for c in ("short_tfs", "tfs")])
        terms = self.places[: len(self.tfs)]
        norm = self.tfs + scale.k1 * (1 - scale.b + scale.b * length[terms] / scale.mean)
        n_terms = int(((kind == _TERM) | (kind == _LONG_TERM)).sum())
        weights = np.repeat(blocks.column("weight").to_numpy()[:n_terms], np.diff(self.start[: n_terms + 1]))
        # What a posting adds to a score, and each block at most.
        self.gain = weights * np.where(counts[terms], self.tfs * (scale.k1 + 1) / norm, 0.0)
        self.most = np.zeros(blocks.num_rows)
        if n_terms:
            self.most[:n_terms] = np.maximum.reduceat(self.gain, self.start[:n_terms])
        sizes = np.diff(self.start[: n_terms + 1])
        common = np.argsort(-sizes, kind="stable")[: ROW_CELLS // self.n if self.n else 0]
        common = np.sort(common[sizes[common] * ROW_SHARE > self.n])
        table, row = np.zeros((len(common), self.n)), np.repeat(np.arange(n_terms), sizes)
        is_common = np.isin(row, common)
        table[np.searchsorted(common, row[is_common]), terms[is_common]] = self.gain[is_common]
        self.rows = dict(zip(common.tolist(), table, strict=True))
        self.is_row = np.zeros(blocks.num_rows, dtype=bool)
        self.is_row[common] = True
        self.said_before = np.concatenate([[0], np.cumsum(self.tfs)])
        self.tagged: dict[tuple, np.ndarray] = {}
        self.positions, self.spoken = _flat(blocks.column("positions"))
        tids = blocks.column("tid").to_numpy()
        self.order = np.argsort(tids, kind="stable")
        self.tids = tids[self.order]
        self.known = dict(zip(tids.tolist(), range(len(tids)), strict=True))

    def find(self, tids: np.ndarray) -> np.ndarray:
        """The block of each term, -1 where the shard has none."""
        if not len(self.tids):
            return np.full(len(tids), -1)
        at = np.minimum(np.searchsorted(self.tids, tids), len(self.tids) - 1)
        return np.where(self.tids[at] == tids, self.order[at], -1)

    def of(self, block: int) -> np.ndarray:
        return self.places[self.start[block] : self.start[block + 1]]

    def holding(self, tids: list[int]) -> np.ndarray:
        """Whether each place has one of the tags."""
        key = tuple(tids)
        if key not in self.tagged:
            held = np.zeros(self.n, dtype=bool)
            for t in tids:
                if t in self.known:
                    held[self.of(self.known[t])] = True
            self.tagged[key] = held
        return self.tagged[key]

    def having(self, block: int, places: np.ndarray) -> np.ndarray:
        """Whether each of some places that count has the term of a block."""
        if block in self.rows:
            return self.rows[block][places] > 0
        there = self.of(block)
        return there[np.minimum(np.searchsorted(there, places), len(there) - 1)] == places

    def gains(self, block: int, places: np.ndarray) -> np.ndarray:
        """What a term adds to the scores of some places."""
        if block in self.rows:
            return self.rows[block][places]
        first, end = self.start[block], self.start[block + 1]
        at = first + np.minimum(np.searchsorted(self.places[first:end], places), end - first - 1)
        return np.where(self.places[at] == places, self.gain[at], 0.0)

    def needed(self, branch: dict) -> list[int] | None:
        """Blocks of the words a branch requires, the rarest first; None where the shard lacks one."""
        blocks = [self.known.get(t, -1) for t in branch["need"]]
        return None if -1 in blocks else sorted(blocks, key=lambda i: self.start[i + 1] - self.start[i])

    def fulfilling(self, branch: dict, blocks: list[int], open_: np.ndarray) -> np.ndarray:
        """The open places that fulfil a branch, whose required words have these blocks."""
        held = self.of(blocks[0])
        held = held[open_[held]]
        for i in blocks[1:]:
            if not len(held):
                return held
            held = held[self.having(i, held)]
        for t in branch["bar"]:
            if t in self.known and len(held):
                held = held[~self.having(self.known[t], held)]
        for phrase in branch["phrases"]:
            if len(held):
                held = self.saying([self.known[t] for t in phrase], held)
        return held

    def saying(self, phrase: list[int], held: np.ndarray) -> np.ndarray:
        """Those of the places in which the words follow one another: positions less each word's place in the phrase meet."""
        spots = {}
        for block in set(phrase):
            first = self.start[block]
            entry = first + np.searchsorted(self.of(block), held)
            tf = self.tfs[entry]
            ends = np.cumsum(tf)
            spot = np.arange(ends[-1]) + np.repeat(self.spoken[block] + self.said_before[entry] - self.said_before[first] - (ends - tf), tf)
            spots[block] = (np.repeat(held, tf).astype(np.int64) << 32) + self.positions[spot]
        first = min(range(len(phrase)), key=lambda i: len(spots[phrase[i]]))
        starts = spots[phrase[first]] - first
        for i, block in enumerate(phrase):
            there = spots[block]
            if i != first and len(starts):
                at = np.minimum(np.searchsorted(there, starts + i), len(there) - 1)
                starts = starts[there[at] == starts + i]
        return np.unique(starts >> 32)


class _Tile:
    """Queries of a task and the best places each has reached so far."""

    def __init__(self, rows: pa.Table | None, scale: Scale, limit: int):
        self.n, self.limit = 0 if rows is None else rows.num_rows, limit
        if not self.n:
            return
        self.query_ids = rows.column("query_id").combine_chunks()
        self.tids, self.start = _flat(rows.column("tids"))
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.start))
        self.branches, self.limits = rows.column("branches").to_pylist(), rows.column("limits").to_pylist()
        # Scores and ids found for each query, and how many of them were found since they were last ranked.
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(self.n)]
        self.waiting = [0] * self.n
        self.least = np.full(self.n, -np.inf)

    def meet(self, shard: _Shard) -> None:
        for first in range(0, self.n, MET_QUERIES):
            self._meet(shard, first, min(self.n, first + MET_QUERIES))

    def _meet(self, shard: _Shard, first_query: int, end: int) -> None:
        at, to = self.start[first_query], self.start[end]
        row = self.row[at:to]
        block = shard.find(self.tids[at:to])
        bound = np.where(block >= 0, shard.most[block], 0.0) if len(shard.most) else np.zeros(len(block))
        total = np.add.reduceat(bound, self.start[first_query:end] - at)
        open_ = (total > 0) & (total >= self.least[first_query:end] - ROUNDING)
        ready, branches, masks = [], {}, {}
        for i in np.flatnonzero(open_).tolist():
            q = first_query + i
            if self.branches[q]:
                # A shard that lacks a required word has nothing for that branch.
                branches[i] = [(b, blocks) for b in self.branches[q] if (blocks := shard.needed(b)) is not None]
            if self.limits[q]:
                masks[i] = np.logical_and.reduce([shard.holding(tags) for tags in self.limits[q]])
            if branches.get(i, True) and (i not in masks or masks[i].any()):
                ready.append(i)
        open_[:] = False
        open_[ready] = True
        used = np.flatnonzero((bound > 0) & open_[row - first_query])
        used = used[np.lexsort((-bound[used], row[used]))]
        block, bound, own = block[used], bound[used], row[used] - first_query
        edges = np.searchsorted(own, np.arange(end - first_query + 1))
        # What the terms of a query after each can still add. Those that add least are looked up only for passages in reach.
        before = np.append(0.0, np.cumsum(bound))
        after = np.maximum(before[edges[1:]][own] - before[1:], 0.0) + ROUNDING
        first = np.append(True, own[1:] != own[:-1])[: len(own)]
        early = first | (after + bound > LATER * self.least[first_query:end][own])
        early_terms = np.append(0, np.cumsum(early))[edges]
        few = np.flatnonzero(early & ~shard.is_row[block])
        at_few = np.searchsorted(own[few], np.arange(end - first_query + 1))
        starts, sizes = shard.start[block[few]], shard.start[block[few] + 1] - shard.start[block[few]]
        block, after, edges, early_terms, rows = block.tolist(), after.tolist(), edges.tolist(), early_terms.tolist(), shard.rows
        for group in range(0, len(ready), SUMMED_QUERIES):
            now = ready[group : group + SUMMED_QUERIES]
            # Postings of words that are not common are summed for several queries at once.
            x, y = at_few[now[0]], at_few[now[-1] + 1]
            lengths = sizes[x:y]
            ends = np.cumsum(lengths)
            spots = np.arange(lengths.sum()) + np.repeat(starts[x:y] - (ends - lengths), lengths)
            lines = np.searchsorted(now, own[few[x:y]]) * shard.n
            # Without any posting there is nothing to take the kind of the sums from.
            summed = np.bincount(shard.places[spots] + np.repeat(lines, lengths), shard.gain[spots], len(now) * shard.n).astype(np.float64, copy=False)
            for i, sums in zip(now, summed.reshape(len(now), shard.n), strict=True):
                q, a, z = first_query + i, edges[i], edges[i + 1]
                m, least = a + early_terms[i + 1] - early_terms[i], self.least[q] - ROUNDING
                for t in block[a:m]:
                    if t in rows:
                        np.add(sums, rows[t], sums)
                reach = sums >= max(least - (after[m - 1] if m < z else 0.0), _LEAST)
                if i in masks:
                    reach &= masks[i]
                if i in branches:
                    met = [shard.fulfilling(b, blocks, reach) for b, blocks in branches[i]]
                    near = met[0] if len(met) == 1 else np.unique(np.concatenate(met))
                else:
                    near = np.flatnonzero(reach)
                found = sums[near]
                for j in range(m, z):
                    if not len(near):
                        break
                    found = found + shard.gains(block[j], near)
                    reach = found >= least - (after[j] if j + 1 < z else 0.0)
                    near, found = near[reach], found[reach]
                if len(near) > self.limit:
                    reach = found >= np.partition(found, len(near) - self.limit)[-self.limit] - ROUNDING
                    near, found = near[reach], found[reach]
                if len(near):
                    self.add(q, np.round(found, 6), shard.ids[near])

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        self.found[q].append((scores, ids))
        self.waiting[q] += len(scores)
        if self.waiting[q] >= self.limit:
            self.rank(q)

    def rank(self, q: int) -> None:
        """Keep the best of what was found for a query."""
        found = self.found[q]
        scores, ids = found[0] if len(found) == 1 else (np.concatenate([f[i] for f in found]) for i in (0, 1))
        if len(scores) > self.limit:
            least = np.partition(scores, len(scores) - self.limit)[-self.limit]
            high = scores >= least
            scores, ids = scores[high], ids[high]
            if len(scores) > self.limit:  # of equal scores the first ids
                high = np.lexsort((ids, -scores))[: self.limit]
                scores, ids = scores[high], ids[high]
            self.least[q] = least
        elif len(scores) == self.limit:
            self.least[q] = scores.min()
        self.found[q], self.waiting[q] = [(scores, ids)], 0

    def results(self) -> Iterator[pa.RecordBatch]:
        for first in range(0, self.n, 1_000):
            met = [q for q in range(first, min(self.n, first + 1_000)) if self.found[q]]
            if met:
                for q in met:
                    self.rank(q)
                best = [self.found[q][0] for q in met]
                starts = pa.array(np.cumsum([0, *[len(scores) for scores, _ in best]]).astype(np.int32))
                scores, ids = (np.concatenate([b[i] for b in best]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        self.query_ids.take(pa.array(met)), pa.ListArray.from_arrays(starts, pa.array(ids)),
                        pa.ListArray.from_arrays(starts, pa.array(np.rint(scores * 1e6).astype(np.int64))),
                    ],
                    names=["query_id", "ids", "millionths"],
                )
