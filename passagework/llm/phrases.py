"""Repeated phrases removed with Aho-Corasick automata.

Windows that recur are confirmed within the stretches of one anchor and joined into passages. The passages of a shard of
anchors are compiled into one automaton, and the shard's stretches of all documents are streamed through it, which
locates every occurrence literally.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import chunks, mapped
from passagework.llm.passages import FOUND, WORDS, compared, rows_with_ranges, stretches
from passagework.llm.word_codes import WordHashes, runs

#: Characters of passages in one automaton.
AUTOMATON_CHARS = 1_000_000
SCHEMA = {n: t for n, t in (x.split() for x in FOUND.split(", "))}


def found_rows(**columns) -> pa.RecordBatch:
    """A batch of FOUND; columns that aren't given are null."""
    n = len(next(iter(columns.values())))
    types = {"long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(c, [None] * n), types[t]) for c, t in SCHEMA.items()], list(SCHEMA)
    )


def _locate(texts: list[str], passages: list[str]) -> Iterator[tuple[int, int, int]]:
    """(text, first word, past-the-last word) of every occurrence; texts and passages are framed by blanks."""
    automaton = ahocorasick.Automaton()
    for p in passages:
        automaton.add_word(p, len(p))
    automaton.make_automaton()
    for i, text in enumerate(texts):
        found = np.array(list(automaton.iter(text)), dtype=np.int64)
        if len(found):
            blanks = np.flatnonzero(np.frombuffer(text.encode("latin-1"), dtype=np.uint8) == 32)
            first, last = np.searchsorted(blanks, found[:, 0] + 1 - found[:, 1]), np.searchsorted(blanks, found[:, 0])
            yield from zip([i] * len(found), first.tolist(), last.tolist(), strict=True)


def compare_words(window: int):
    """The comparison of the word stretches of whole tasks."""

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        # Most stretches of a frequent anchor are the same text: each is looked at once and counts as often as it occurs.
        known: dict[tuple[int, bytes], int] = {}
        kinds = np.array([known.setdefault(k, len(known)) for k in zip(table.column("task").to_pylist(), table.column("stretch").to_pylist(), strict=True)])
        task = np.array([t for t, _ in known], dtype=np.int64)
        words = [s.split(b" ") for _, s in known]
        often = np.bincount(kinds)
        sizes = np.array([len(w) for w in words])
        lens = sizes - window + 1  # windows of each stretch
        firsts = np.cumsum(lens) - lens
        owner = np.repeat(np.arange(len(words)), lens)
        place = np.arange(len(owner)) - firsts[owner]
        # All stretches in one pass; runs across two of them are not looked at.
        codes = runs(hashes.of([x for w in words for x in w]), window)
        every = codes[(np.cumsum(sizes) - sizes)[owner] + place] ^ (task[owner].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first, which = np.unique(every, return_index=True, return_inverse=True)
        counts = np.bincount(which, weights=often[owner]).astype(np.int64)
        again = counts[which] > 1
        # Runs of recurring windows are passages.
        patterns: dict[str, set[int]] = {}
        hit = np.flatnonzero(again)
        if len(hit):
            cuts = np.flatnonzero((hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]]))
            heads, tails = hit[np.concatenate([[0], cuts + 1])], hit[np.concatenate([cuts, [len(hit) - 1]])]
            for i, x, y in zip(owner[heads].tolist(), place[heads].tolist(), place[tails].tolist(), strict=True):
                patterns.setdefault((b" " + b" ".join(words[i][x : y + window]) + b" ").decode("latin-1"), set()).add(i)
        gone: list[tuple[int, int, int]] = []
        shard: list[str] = []
        size, holders = 0, set()
        for p in [*patterns, None]:
            if p is None or size + len(p) > AUTOMATON_CHARS and shard:
                held = sorted(holders)
                texts = [(b" " + b" ".join(words[i]) + b" ").decode("latin-1") for i in held]
                gone += [(held[i], x, y) for i, x, y in _locate(texts, shard)]
                shard, size, holders = [], 0, set()
            if p is not None:
                shard.append(p)
                size += len(p)
                holders |= patterns[p]
        row, at, back, shared = (table.column(c).to_numpy() for c in ("row", "at", "back", "shared"))
        base = (at - back).astype(np.int64)
        if gone:
            spans = np.array(list(_joined(gone)), dtype=np.int64)
            start, n = np.searchsorted(spans[:, 0], kinds), np.bincount(spans[:, 0], minlength=len(words))[kinds]
            rows = np.repeat(np.arange(len(kinds)), n)
            span = np.repeat(start, n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            yield found_rows(row=row[rows], a=(base[rows] + spans[span, 1]).astype(np.int32), b=(base[rows] + spans[span, 2]).astype(np.int32))
        one = np.zeros(len(words), dtype=np.int64)
        one[kinds[::-1]] = np.arange(len(kinds))[::-1]  # the first row of each stretch
        new = first[shared[one[owner[first]]]]
        if len(new):
            digests = [xxhash.xxh3_128_intdigest(b" ".join(words[o][p : p + window])) for o, p in zip(owner[new].tolist(), place[new].tolist(), strict=True)]
            holder = one[owner[new]]
            yield found_rows(
                row=row[holder], start=(base[holder] + place[new]).astype(np.int32), n=counts[which[new]],
                high=np.array([d >> 64 for d in digests], dtype=np.uint64).view(np.int64), low=np.array([d & (1 << 64) - 1 for d in digests], dtype=np.uint64).view(np.int64),
            )

    return compare


def _joined(gone: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Overlapping ranges of one row as one."""
    held = None
    for r, a, b in sorted(set(gone)):
        if held and held[0] == r and a <= held[2]:
            held[2] = max(held[2], b)
        else:
            if held:
                yield tuple(held)
            held = [r, a, b]
    if held:
        yield tuple(held)


def repeated_phrases(docs: DataFrame, window: int = 35) -> DataFrame:
    """(row, a, b): word ranges of rows that are covered by windows which also start anywhere else."""
    found = compared(stretches(docs, WORDS(window=window)), compare_words(window))
    heads = found.where("n is not null")
    sums = heads.groupBy("high", "low").agg(F.sum("n").alias("total")).where("total > 1")
    late = heads.join(sums, ["high", "low"]).select("row", F.col("start").alias("a"), (F.col("start") + window).alias("b"))
    return found.where("a is not null").select("row", "a", "b").unionByName(late)


def remove_repeated_phrases(docs: DataFrame, window: int = 35) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words that stay, joined by one blank).

    Words are runs between ASCII white space, unchanged. A word goes if some window of `window` consecutive words that
    covers it also starts at any other place of any document; windows are judged on the input. A null text has no words;
    rows that repeat are documents of their own and so remove each other; a text shorter than a window stays; an empty
    table gives no rows; further columns are not read.
    """

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            made = []
            for t, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                words = (t or "").encode("utf-8", "replace").split()
                stays = np.ones(len(words), dtype=bool)
                for g in gone or ():
                    stays[g["a"] : g["b"]] = False
                kept = b" ".join(w for w, s in zip(words, stays.tolist(), strict=True) if s) if gone else b" ".join(words)
                made.append((len(words), len(words) - int(stays.sum()), kept.decode()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return rows_with_ranges(docs, repeated_phrases(docs, window)).select("doc_id", "text", "gone").transform(
        mapped, strike, "doc_id long, n_words long, n_removed long, kept string"
    )

