"""Repeated byte strings removed by sorting suffixes, deep-shallow.

The stretches around an anchor are compared by sorting what follows the anchor, and what precedes it backwards. Sorting
goes eight bytes at a time, as multikey quicksort does with wide symbols, down to a shallow depth; groups that are still
equal there are ordered by blind tries. The common prefix lengths of neighbours then tell which windows are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import chunks, mapped
from passagework.llm.passages import BYTES, compared, rows_with_ranges, stretches
from passagework.llm.phrases import found_rows

#: Bytes sorted by multikey quicksort before blind tries take over.
SHALLOW = 24


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different strings of one length."""
    low, high = 0, len(a)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """Orders distinct strings of one length; inner nodes hold a depth and the bytes that branch there."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: int | tuple[int, dict] = 0
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        # Down blindly to some leaf, looking at branching bytes only; then one comparison finds the place.
        while not isinstance(node, int):
            depth, below = node
            node = below[s[depth]] if s[depth] in below else next(iter(below.values()))
        other = self.strings[node]
        split = _common(s, other)
        above, node = None, self.root
        while not isinstance(node, int) and node[0] < split:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == split:
            node[1][s[split]] = i
            return
        new = (split, {other[split]: node, s[split]: i})
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]]] = new

    def sorted(self) -> Iterator[tuple[int, int]]:
        """(string, length of the prefix it shares with the one before), in order; the first has -1."""
        stack: list[tuple[object, int]] = [(self.root, -1)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, int):
                yield node, shared
                continue
            depth, below = node
            branches = sorted(below)
            for k in reversed(range(len(branches))):
                stack.append((below[branches[k]], depth if k else shared))


def sort_suffixes(strings: list[bytes], groups: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by group and then bytes, and the length each shares with the one before (-1: another group).

    Strings are compared as if they went on with zero bytes; equal ones share the common width.
    """
    n = len(strings)
    width = -(-max(map(len, strings), default=1) // 8) * 8 or 8
    matrix = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(n, width)
    words = matrix.view(">u8").astype(np.uint64)
    order = np.argsort(groups, kind="stable")
    shared = np.full(n, width, dtype=np.int64)
    shared[np.concatenate([[True], groups[order][1:] != groups[order][:-1]])] = -1
    for k in range(min(shallow, width) // 8):
        tied = np.cumsum(shared < width)  # classes that are equal so far
        sizes = np.bincount(tied)
        active = np.flatnonzero(sizes[tied] > 1)
        if not len(active):
            break
        own, part = tied[active], order[active]
        order[active] = part[np.lexsort((words[part, k], own))]
        part = order[active]
        inside = own[1:] == own[:-1]
        differ = np.flatnonzero(inside & (words[part[1:], k] != words[part[:-1], k])) + 1
        a, b = matrix[part[differ - 1], 8 * k : 8 * k + 8], matrix[part[differ], 8 * k : 8 * k + 8]
        shared[active[differ]] = 8 * k + (a != b).argmax(1)
    tied = np.cumsum(shared < width)
    starts = np.flatnonzero(np.concatenate([[True], tied[1:] != tied[:-1]])) if n else np.zeros(0, int)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
        if e - s > 1 and shallow < width:
            held: dict[bytes, list[int]] = {}
            for i in order[s:e].tolist():
                held.setdefault(matrix[i, shallow:].tobytes(), []).append(i)
            if len(held) == 1:
                continue
            keys, at = list(held), s
            for k, common in BlindTrie(keys).sorted():
                own = held[keys[k]]
                order[at : at + len(own)] = own
                if at > s:
                    shared[at] = shallow + common
                shared[at + 1 : at + len(own)] = width
                at += len(own)
    return order, shared


def compare_bytes(window: int):
    """The comparison of the byte stretches of whole tasks."""

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        doc = table.column("doc_id")
        missing = np.array(doc.is_null())
        ids = doc.fill_null(0).to_numpy()
        row, at = table.column("row").to_numpy(), table.column("at").to_numpy().astype(np.int64)
        task = table.column("task").to_numpy()
        order = np.lexsort((at, row, ids, missing, task))
        # A row that repeats brings its stretches again.
        again = np.concatenate([[False], (row[order][1:] == row[order][:-1]) & (at[order][1:] == at[order][:-1]) & (task[order][1:] == task[order][:-1])])
        table = table.take(pa.array(order[~again]))
        # A stretch that has been seen before, in this order, goes whole; only first ones are sorted.
        seen: dict[tuple[int, int, bytes], int] = {}
        keys = zip(table.column("task").to_pylist(), table.column("back").to_pylist(), table.column("stretch").to_pylist(), strict=True)
        fresh = np.array([seen.setdefault(k, i) == i for i, k in enumerate(keys)])
        if not fresh.all():
            late = table.filter(pa.array(~fresh))
            start = late.column("at").to_numpy().astype(np.int64) - late.column("back").to_numpy()
            end = start + late.column("windows").to_numpy() - 1 + window
            yield found_rows(row=late.column("row").to_numpy(), a=start.astype(np.int32), b=end.astype(np.int32))
            table = table.filter(pa.array(fresh))
        row, task = table.column("row").to_numpy(), table.column("task").to_numpy()
        at, back, windows = (table.column(c).to_numpy().astype(np.int64) for c in ("at", "back", "windows"))
        shared_task = table.column("shared").to_numpy()
        stretch = table.column("stretch").to_pylist()
        n = len(stretch)
        after, after_shared = sort_suffixes([s[b:] for s, b in zip(stretch, back.tolist(), strict=True)], task)
        before, before_shared = sort_suffixes([s[:b][::-1] for s, b in zip(stretch, back.tolist(), strict=True)], task)
        rank_after, rank_before = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        rank_after[after], rank_before[before] = np.arange(n), np.arange(n)
        least = back - windows + 1
        marked_row, marked_start = [], []
        heads: list[tuple[int, int]] = []
        for o in range(int(least.min()), int(back.max()) + 1):
            active = np.flatnonzero((least <= o) & (o <= back))
            if not len(active):
                continue
            # Windows that begin o bytes before the anchor are equal if both sides are, this far.
            left = np.cumsum(before_shared < o)[rank_before[active]]
            right = np.cumsum(after_shared < window - o)[rank_after[active]]
            _, first = np.unique(left * (n + 1) + right, return_index=True)
            later = np.ones(len(active), dtype=bool)
            later[first] = False
            marked_row.append(active[later])
            marked_start.append(at[active[later]] - o)
            hot = active[first][shared_task[active[first]]]
            heads += [(int(i), o) for i in hot]
        i, start = np.concatenate(marked_row), np.concatenate(marked_start)
        if len(i):
            line = np.lexsort((start, i))
            i, start = i[line], start[line]
            cuts = np.flatnonzero((i[1:] != i[:-1]) | (start[1:] - start[:-1] > window))
            firsts, lasts = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(i) - 1]])
            yield found_rows(row=row[i[firsts]], a=start[firsts].astype(np.int32), b=(start[lasts] + window).astype(np.int32))
        if heads:
            digests = [xxhash.xxh3_128_intdigest(stretch[i][int(back[i]) - o : int(back[i]) - o + window]) for i, o in heads]
            who = np.array([i for i, _ in heads])
            yield found_rows(
                row=row[who], doc_id=table.column("doc_id").take(pa.array(who)).to_pylist(),
                start=(at[who] - np.array([o for _, o in heads])).astype(np.int32), n=np.ones(len(who), dtype=np.int64),
                high=np.array([d >> 64 for d in digests], dtype=np.uint64).view(np.int64), low=np.array([d & (1 << 64) - 1 for d in digests], dtype=np.uint64).view(np.int64),
            )

    return compare


def repeated_strings(docs: DataFrame, window: int = 100) -> DataFrame:
    """(row, a, b): byte ranges of rows covered by `window`-byte strings that also start earlier."""
    found = compared(stretches(docs, BYTES(window=window)), compare_bytes(window))
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row", "start")
    heads = found.where("n is not null").select("high", "low", "row", "start", place.alias("place"))
    firsts = heads.groupBy("high", "low").agg(F.min("place").alias("first"))
    late = heads.join(firsts, ["high", "low"]).where(~F.col("place").eqNullSafe(F.col("first")))
    return found.where("a is not null").select("row", "a", "b").unionByName(
        late.select("row", F.col("start").alias("a"), (F.col("start") + window).alias("b"))
    )


def remove_repeated_strings(docs: DataFrame, window: int = 100) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal runs that go), kept (the remaining bytes).

    A byte goes if a string of `window` bytes that covers it also starts earlier: in a row of smaller doc_id or earlier
    in the same one. Texts are judged as they came in, as UTF-8 bytes; a null text is empty; strings never cross texts. A null doc_id
    comes after all others; rows of one doc_id with different texts are ordered by a hash, and rows that repeat in both
    are one text, each with its result. A text shorter than the window stays; an empty table gives no rows; further
    columns are not read.
    """

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            made = []
            for t, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                raw = (t or "").encode("utf-8", "replace")
                spans: list[list[int]] = []
                for s, e in sorted((g["a"], g["b"]) for g in gone or ()):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                edges = [0, *[x for s in spans for x in s], len(raw)]
                kept = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                made.append((len(raw), len(raw) - len(kept), len(spans), kept))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return rows_with_ranges(docs, repeated_strings(docs, window)).select("doc_id", "text", "gone").transform(
        mapped, strike, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
