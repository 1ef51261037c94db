"""Windows that occur more than once, found through anchors: what the two passage operators share.

Every window of a text has one anchor, the least-hashed of its short runs, chosen by the window's content alone. Equal
windows therefore have equal anchors at equal offsets. Only anchors that occur twice are followed up, with the stretch
of text whose windows they are the anchor of; stretches of one anchor meet in one task. Stretches of a very frequent
anchor are dealt into several tasks, which compare what they hold and pass on one row per distinct window.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import chunks, mapped
from passagework.llm.decontamination import row_key
from passagework.llm.word_codes import MULTIPLIER, WordHashes, mixed
from passagework.session import materialise

#: Stretches of one anchor that one task compares at a time.
TOGETHER = 2000


@functools.cache
def _hashes() -> WordHashes:
    return WordHashes()


@functools.cache
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_units(text: bytes) -> np.ndarray:
    """Codes of the words between ASCII white space."""
    return _hashes().of(text.split())


def byte_units(text: bytes) -> np.ndarray:
    return _byte_codes()[np.frombuffer(text, dtype=np.uint8)]


def doubled_runs(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` (a power of two) codes that start at each place, in log2(length) passes."""
    factor, out = MULTIPLIER, codes
    while length > 1:
        half = len(codes) - len(out) + 1
        out = out[:-half] * factor + out[half:] if len(out) > half else out[:0]
        with np.errstate(over="ignore"):
            factor = factor * factor
        length //= 2
    return mixed(out)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the `width` values that start at each place."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(codes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor of a text of these codes."""
    none = np.zeros(0, dtype=np.int64)
    if len(codes) < window:
        return none.astype(np.uint64), none, none, none
    grams = doubled_runs(codes, gram)
    low = np.uint64((1 << 32) - 1)
    # Of equal hashes the leftmost is least, so the choice depends on the window's content only.
    ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    chosen = (least_of(ranked, window - gram + 1) & low).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    return grams[chosen[starts]], chosen[starts], starts, np.concatenate([starts[1:], [len(chosen)]]) - 1


@dataclass(frozen=True)
class Kind:
    """How a text is cut into units, and the lengths of windows and anchors in units."""

    units: Callable[[bytes], np.ndarray]
    window: int
    gram: int
    #: The stretch of a text (bytes) from one unit to another, given its cut form.
    stretch: Callable[[object, int, int], bytes]
    cut: Callable[[bytes], object]


WORDS = functools.partial(Kind, word_units, gram=8, stretch=lambda words, a, b: b" ".join(words[a:b]), cut=bytes.split)
BYTES = functools.partial(Kind, byte_units, gram=16, stretch=lambda text, a, b: text[a:b], cut=bytes)

STRETCHES = "task long, shared boolean, row long, doc_id long, at int, back int, windows int, stretch binary"
FOUND = "row long, a int, b int, doc_id long, start int, high long, low long, n long"


def text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(row_key(docs).alias("row"), "doc_id", "text")


def stretches(docs: DataFrame, kind: Kind) -> DataFrame:
    """The stretches around anchors that occur at least twice, with the task that compares each."""
    rows = text_rows(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            keys, made = b.column("row").to_numpy(), []
            for key, t in zip(keys.tolist(), b.column("text").to_pylist(), strict=True):
                found = anchors(kind.units((t or "").encode("utf-8", "replace")), kind.window, kind.gram)
                if len(found[0]):
                    made.append((found[0], np.full(len(found[0]), key), found[1] << 16 | (found[1] - found[2]) << 8 | (found[3] - found[2])))
            if made:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([m[0] for m in made]).view(np.int64)), *[pa.array(np.concatenate([m[k] for m in made])) for k in (1, 2)]],
                    ["anchor", "row", "spot"],
                )

    spots = rows.select("row", "text").transform(mapped, find, "anchor long, row long, spot long")
    again = materialise(spots.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    # A row's own spots are bounded by its text. Written, so that the shuffles before don't add to those of the texts.
    own = materialise(
        spots.join(again, "anchor").groupBy("row").agg(F.collect_set(F.struct("anchor", "n", "spot")).alias("spots"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            for i in range(b.num_rows):
                text = kind.cut((b.column("text")[i].as_py() or "").encode("utf-8", "replace"))
                spots = b.column("spots")[i].values
                anchor, n, spot = (spots.field(k).to_numpy() for k in range(3))
                at, back, more = spot >> 16, spot >> 8 & 255, spot & 255
                first = at - back
                row = b.column("row")[i].as_py()
                doc = b.column("doc_id")[i].as_py()
                parts = -(-n // TOGETHER)
                part = (mixed((spot ^ row).view(np.uint64)) >> np.uint64(33)).astype(np.int64) % parts
                with np.errstate(over="ignore"):
                    task = anchor + part * np.int64(0x2545F4914F6CDD1D)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(task), pa.array(parts > 1), pa.array(np.full(len(at), row)), pa.array([doc] * len(at), pa.int64()),
                        *[pa.array(x.astype(np.int32)) for x in (at, back, more + 1)],
                        pa.array([kind.stretch(text, a, c) for a, c in zip(first.tolist(), (first + more + kind.window).tolist(), strict=True)], pa.binary()),
                    ],
                    ["task", "shared", "row", "doc_id", "at", "back", "windows", "stretch"],
                )

    return rows.join(own, "row").transform(mapped, cut, STRETCHES)


def batches_of_tasks(batches: Iterator[pa.RecordBatch], rows: int = 4 * TOGETHER) -> Iterator[pa.Table]:
    """Whole tasks together, about `rows` rows at a time, from batches sorted by task."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        start = 0
        while start < b.num_rows:
            part = b.slice(start, max(1, rows - n))
            start += part.num_rows
            held.append(part)
            n += part.num_rows
            if n < rows:
                continue
            whole = pa.Table.from_batches(held)
            tasks = whole.column("task").to_numpy()
            cut = int(np.flatnonzero(tasks != tasks[-1])[-1]) + 1 if tasks[0] != tasks[-1] else 0
            if cut:
                yield whole.slice(0, cut)
                held = whole.slice(cut).to_batches()
                n = whole.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def compared(found: DataFrame, compare: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Apply `compare` to batches of whole tasks; written, as several readers follow.

    It yields rows (row, a, b): units a to b of a text are to go; and rows (row, doc_id, start, high, low, n): n windows
    with this 128-bit hash were seen in a task that shares its anchor with others, the first of them here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of_tasks(batches):
            yield from compare(table)

    return materialise(found.repartition("task").sortWithinPartitions("task").transform(mapped, run, FOUND))


def ranges(a: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Sorted window starts as maximal ranges of covered units."""
    if not len(a):
        return []
    cuts = np.flatnonzero(a[1:] - a[:-1] > window)
    firsts, lasts = a[np.concatenate([[0], cuts + 1])], a[np.concatenate([cuts, [len(a) - 1]])]
    return list(zip(firsts.tolist(), (lasts + window).tolist(), strict=True))


def rows_with_ranges(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Every row of `docs` (row, doc_id, text) with `gone`, the list of its ranges or null."""
    own = gone.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    return text_rows(docs).join(own, "row", "left")
