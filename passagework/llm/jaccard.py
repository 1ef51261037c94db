"""Documents whose word n-grams have a Jaccard similarity of at least a threshold, found by a MinHash LSH forest.

Each tree orders the documents by a label of several MinHash values, as a sorted prefix trie does. A pair meets in a
tree at the length of its common prefix. The length asked for starts at whole labels and is shortened until the chance
of meeting in some tree reaches the target recall at the threshold. What meets and looks similar by its signatures is
gathered in components; within them every pair is verified on its whole shingle sets.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import chunks, mapped
from passagework.llm.decontamination import row_key
from passagework.llm.links import block_pairs, components, each_task, spanning
from passagework.llm.word_codes import WordHashes, shingles
from passagework.session import materialise

#: Standard errors of the signatures' estimate by which it may fall short of the threshold.
DOUBT = 4.0


def prefix_length(threshold: float, trees: int, longest: int, recall: float) -> int:
    """The longest common prefix by which a pair at `threshold` meets in some tree with probability `recall`."""
    length = longest
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


class Signer:
    """MinHash signatures of shingle sets."""

    def __init__(self, size: int):
        rng = np.random.default_rng(size)
        self.factor = rng.integers(1, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, size, dtype=np.uint32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factor), 0xFFFFFFFF, dtype=np.uint32)
        for s in range(0, len(short), 2048):
            spread = short[s : s + 2048, None] * self.factor + self.shift
            np.minimum(least, (spread ^ (spread >> np.uint32(15))).min(0), out=least)
        return least


@functools.cache
def _signer(size: int) -> Signer:
    return Signer(size)


@functools.cache
def _hashes() -> WordHashes:
    return WordHashes()


def shingle_sets(texts: list[str | None], length: int) -> list[np.ndarray]:
    hashes = _hashes()
    return [shingles(hashes.of((t or "").encode("utf-8", "replace").split()), length) for t in texts]


def sketches(docs: DataFrame, length: int, trees: int, longest: int, prefix: int) -> DataFrame:
    """Per row with words: row, doc_id, node (of its shingle set), n (its size), signature, prefixes (one per tree)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _signer(trees * longest)
        for b in chunks(batches):
            sets = shingle_sets(b.column("text").to_pylist(), length)
            kept = [i for i, s in enumerate(sets) if len(s)]
            if not kept:
                continue
            signatures = np.stack([signer.of(sets[i]) for i in kept])
            heads = np.ascontiguousarray(signatures.reshape(len(kept), trees, longest)[:, :, :prefix]).astype(np.uint64)
            spots = np.zeros((len(kept), trees), dtype=np.uint64) + np.arange(1, trees + 1, dtype=np.uint64)
            for k in range(prefix):
                spots = (spots ^ heads[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                spots ^= spots >> np.uint64(29)
            part = b.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"), part.column("doc_id"),
                    pa.array(np.array([xxhash.xxh3_64_intdigest(sets[i].tobytes()) for i in kept], dtype=np.uint64).view(np.int64)),
                    pa.array([len(sets[i]) for i in kept], pa.int64()),
                    pa.array([s.tobytes() for s in signatures], pa.binary()),
                    pa.array(spots.view(np.int64).tolist(), pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "node", "n", "signature", "prefixes"],
            )

    rows = docs.select(row_key(docs).alias("row"), "doc_id", "text").where("doc_id is not null")
    return rows.transform(mapped, sketch, "row long, doc_id long, node long, n long, signature binary, prefixes array<long>")


def candidates(nodes: DataFrame, threshold: float, trees: int, longest: int, prefix: int) -> DataFrame:
    """Spanning edges (a, b) of the nodes that meet in some tree and whose signatures don't rule the threshold out."""
    size = trees * longest
    least = threshold - DOUBT * (threshold * (1 - threshold) / size) ** 0.5
    spots = nodes.select("id", F.explode("prefixes").alias("bucket"))
    crowded = spots.groupBy("bucket").count().where("count > 1").select("bucket")
    shared = materialise(spots.join(crowded, "bucket"))
    dealt = block_pairs(shared, ["bucket"]).join(nodes.select("id", "signature"), "id")

    def meet(group: pa.Table) -> Iterator[dict]:
        ids = group.column("id").to_numpy()
        if len(ids) < 2:
            return
        signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), dtype=np.uint32).reshape(len(ids), size)
        order = np.lexsort(signatures.T[::-1])
        ids, signatures = ids[order], signatures[order]
        # In trie order the longest prefixes stand side by side: where neighbours form one chain, no more is asked.
        beside = (signatures[1:] == signatures[:-1]).mean(1) >= least
        if beside.all():
            yield {"a": ids[:-1].tolist(), "b": ids[1:].tolist()}
            return
        alike = np.zeros((len(ids), len(ids)), dtype=bool)
        for i in range(len(ids)):
            alike[i, i + 1 :] = (signatures[i + 1 :] == signatures[i]).mean(1) >= least
        a, b = spanning(alike, ids, ids)
        if a:
            yield {"a": a, "b": b}

    return each_task(dealt, ["id", "signature"], meet, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], same: bool) -> np.ndarray:
    """Sizes of the intersections of each left with each right set of sorted hashes."""
    every = left if same else left + right
    if len(every) <= 4:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], dtype=np.float64)
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    values = np.concatenate(every)
    _, place, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts[place] > 1  # a hash of one set adds to no intersection
    ranks = np.cumsum(counts > 1) - 1
    owner, place = owner[shared], ranks[place[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    width = 4096
    for s in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [s, s + width])
        block = np.zeros((len(every), width), dtype=np.float32)
        block[owner[a:b], place[a:b] - s] = 1
        out += block[: len(left)] @ (block if same else block[len(left) :]).T
    return out


def verified(docs: DataFrame, members: DataFrame, length: int, threshold: float) -> DataFrame:
    """Exact links within components: rows (id, n) with a node's linked rows, and rows (id, b) with spanning edges.

    `members` has component, id, copies, n and row, one row of documents that has the node's shingles.
    """
    narrow = members.select("component", "id", "copies", "n")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            sets = shingle_sets(b.column("text").to_pylist(), length)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.tobytes() for s in sets], pa.large_binary()).cast(pa.binary())], ["id", "shingles"])

    # The members grow with the corpus, so they are shuffled at every size and never broadcast.
    texts = docs.where("doc_id is not null").select(row_key(docs).alias("row"), "text").join(members.select("row", "id").hint("merge"), "row")
    sets = texts.select("id", "text").transform(mapped, cut, "id long, shingles binary")
    dealt = block_pairs(narrow, ["component"], "n").join(sets, "id")

    def verify(group: pa.Table) -> Iterator[dict]:
        # Rows that repeat in the input have brought their node more than once.
        _, once = np.unique(group.column("id").to_numpy(), return_index=True)
        group = group.take(pa.array(once))
        ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in group.column("shingles").to_pylist()]
        left, right = (np.flatnonzero(group.column(c).to_numpy()) for c in ("left", "right"))
        if not len(left) or not len(right):
            return
        same = len(left) == len(right) and bool((left == right).all())
        met = overlaps([sets[i] for i in left], [sets[i] for i in right], same)
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        linked = met / (sizes[left][:, None] + sizes[right][None, :] - met) >= threshold
        if same:
            np.fill_diagonal(linked, False)
            counts, who = linked @ copies[right], ids[left]
        else:
            counts, who = np.concatenate([linked @ copies[right], linked.T @ copies[left]]), np.concatenate([ids[left], ids[right]])
        a, b = spanning(linked, ids[left], ids[right])
        yield {
            "id": pa.array([*who.tolist(), *a], pa.int64()),
            "n": pa.array([*counts.astype(np.int64).tolist(), *[0] * len(a)], pa.int64()),
            "b": pa.array([*[None] * len(who), *b], pa.int64()),
        }

    return each_task(dealt, ["id", "copies", "shingles"], verify, "id long, n long, b long")


def similar_documents(
    docs: DataFrame, *, length: int = 5, threshold: float = 0.8, trees: int = 16, longest: int = 6, recall: float = 0.999
) -> DataFrame:
    """Per row: row (its key), doc_id, class_id, n_links, kept.

    Links join rows whose sets of `length`-word shingles have a Jaccard similarity of at least `threshold`; words are
    runs between ASCII white space, unchanged, and a text of fewer words is one shingle. n_links counts the other rows
    linked directly, class_id is the smallest doc_id reachable by links, and kept says whether doc_id is it. Rows of
    equal shingles are compared once and counted as often as they occur. A null text, one without words and a null
    doc_id link with nothing and are classes of their own. Whole texts are read; further columns aren't; an empty table
    gives no rows.
    """
    prefix = prefix_length(threshold, trees, longest, recall)
    rows = materialise(sketches(docs, length, trees, longest, prefix))
    nodes = materialise(
        rows.groupBy(F.col("node").alias("id"))
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("prefixes").alias("prefixes"))
    )
    near = components(materialise(candidates(nodes, threshold, trees, longest, prefix).distinct()))
    members = materialise(nodes.select("id", "copies", "n", "row").join(near, "id"))
    found = materialise(verified(docs, members, length, threshold))
    counted = found.groupBy("id").agg(F.sum("n").alias("linked"))
    reached = components(found.where("b is not null").select(F.col("id").alias("a"), "b"))
    grouped = nodes.select("id", "copies", "least").join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = grouped.groupBy("component").agg(F.min("least").alias("class_id"))
    classes = grouped.join(least, "component").join(counted, "id", "left").select(
        F.col("id").alias("node"), "class_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    keyed = rows.select("row", "node").distinct().join(classes, "node")
    every = docs.select(row_key(docs).alias("row"), "doc_id")
    return every.join(keyed, "row", "left").select(
        "row", "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The row of each class whose doc_id is the class's smallest, with all columns of `docs`.

    Should that doc_id repeat, one of its rows with the least key stays.
    """
    found = materialise(similar_documents(docs, **options))
    held = found.where("kept")
    # A class keeps one row key; rows without a class (no words, no doc_id) each stay.
    one = held.where("doc_id is not null").groupBy("class_id").agg(F.min("row").alias("row"))
    wordless = held.where("n_links = 0").select("row")
    name = f"_row_{uuid.uuid4().hex}"  # clashes with no column of docs
    stay = materialise(one.select("row").union(wordless).distinct().select(F.col("row").alias(name)))
    kept = docs.join(stay, row_key(docs) == F.col(name), "left_semi")
    twice = found.where("kept and n_links > 0").groupBy("row").count().where("count > 1")
    if not twice.take(1):
        return kept
    return kept.withColumn(name, row_key(kept)).dropDuplicates([name]).drop(name)
