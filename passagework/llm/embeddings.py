"""Near-duplicate vectors by cross-polytope hashing.

Vectors are turned by pseudo-random rotations, each three rounds of random signs and a fast Hadamard transform. A
rotated vector hashes to its largest coordinate with its sign; a table joins a few such hashes. Besides its own bucket
a vector visits those of its closest runners-up. Vectors of one bucket and label are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import mapped
from passagework.llm.links import block_pairs, components, each_task, spanning
from passagework.session import materialise

SEED = 20_240_611


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    out, width, half = rows.copy(), rows.shape[1], 1
    while half < width:
        view = out.reshape(len(rows), width // (2 * half), 2, half)
        a, b = view[:, :, 0, :].copy(), view[:, :, 1, :].copy()
        view[:, :, 0, :], view[:, :, 1, :] = a + b, a - b
        half *= 2
    return out / np.sqrt(width)


def buckets(unit: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """(vectors, tables, 1 + probes) bucket codes of unit rows; the first is the vector's own.

    A probe replaces the hash whose runner-up lies closest to its winner, the next probe the next such.
    """
    n, dims = unit.shape
    width = 1 << max(0, dims - 1).bit_length()
    rows = np.zeros((n, width))
    rows[:, :dims] = unit
    out = np.zeros((n, tables, 1 + probes), dtype=np.int64)
    rng = np.random.default_rng(SEED)
    every = np.arange(n)
    for t in range(tables):
        best, second, gap = [], [], []
        for _ in range(hashes):
            turned = rows
            for _ in range(3):
                turned = hadamard(turned * rng.choice([-1.0, 1.0], width))
            size = np.abs(turned)
            first = size.argmax(1)
            top = size[every, first]
            size[every, first] = -1
            other = size.argmax(1)
            gap.append(top - size[every, other])
            best.append(first * 2 + (turned[every, first] < 0))
            second.append(other * 2 + (turned[every, other] < 0))
        codes, spare, gaps = np.stack(best, 1), np.stack(second, 1), np.argsort(np.stack(gap, 1), axis=1)
        scale = (2 * width) ** np.arange(hashes, dtype=np.int64)
        out[:, t, 0] = codes @ scale
        for p in range(probes):
            changed = codes.copy()
            changed[every, gaps[:, p]] = spare[every, gaps[:, p]]
            out[:, t, 1 + p] = changed @ scale
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal-length packed doubles."""
    return np.stack([np.frombuffer(v, dtype=np.float64) for v in column.to_pylist()])


def near_vectors(vectors: DataFrame, *, threshold: float = 0.98, tables: int = 12, hashes: int = 2, probes: int = 2) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Links join vectors of one non-null label and one length whose cosine in double precision is at least `threshold`.
    A vector that is null, empty, zero or holds a null or a non-finite component links with nothing, and so does a row
    without label. Equal vectors are compared once and counted as often as they occur. Repeated vec_ids are rows of
    their own that count each other where they are linked; a null vec_id takes no part in components. Extra columns are
    not read; an empty table gives no rows.
    """
    if not 0 <= probes <= hashes:
        raise ValueError("a table has one probe per hash at most")
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # Equal vectors of a label are one class, whose id is its smallest vec_id.
    classed = materialise(rows.where(sound).groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                lists = b.column("v")
                lengths = lists.value_lengths().to_numpy()
                for dims in np.unique(lengths).tolist():
                    at = np.flatnonzero(lengths == dims)
                    part = b.take(pa.array(at))
                    raw = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                    big = np.abs(raw).max(1, keepdims=True)
                    unit = raw / big
                    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                    codes = buckets(unit, tables, hashes, probes)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("label").cast(pa.string()), pa.array(np.full(len(at), dims)), part.column("id"), part.column("copies"),
                            pa.array([u.tobytes() for u in unit], pa.binary()),
                            pa.array(codes.reshape(len(at), -1).tolist(), pa.list_(pa.int64())),
                        ],
                        ["label", "dims", "id", "copies", "unit", "codes"],
                    )

    schema = "label string, dims long, id long, copies long, unit binary, codes array<long>"
    hashed_rows = materialise(classed.transform(mapped, hashed, schema))
    spots = hashed_rows.select("label", "dims", "id", F.posexplode("codes").alias("at", "code")).select(
        F.xxhash64("label", "dims", F.floor(F.col("at") / (1 + probes)), "code").alias("bucket"), "id"
    ).distinct()
    crowded = spots.groupBy("bucket").count().where("count > 1").select("bucket")
    shared = materialise(spots.join(crowded, "bucket"))
    dealt = block_pairs(shared, ["bucket"]).join(hashed_rows.select("id", "label", "dims", "unit"), "id")

    def links(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        left, right = (np.flatnonzero(group.column(c).to_numpy()) for c in ("left", "right"))
        ids = group.column("id").to_numpy()
        unit = _matrix(group.column("unit"))
        # Within one block each pair is met twice, and a vector meets itself: keep pairs in id order.
        linked = unit[left] @ unit[right].T >= threshold
        linked &= (ids[left][:, None] < ids[right][None, :]) | ~np.isin(ids[left], ids[right])[:, None]
        return linked, ids[left], ids[right], left

    def forest(group: pa.Table) -> Iterator[dict]:
        for part in _alike(group, ["label", "dims"]):
            linked, a, b, _ = links(part)
            x, y = spanning(linked, a, b)
            if x:
                yield {"a": x, "b": y}

    edges = each_task(dealt, ["id", "label", "dims", "unit"], forest, "a long, b long")
    found = components(materialise(edges.distinct()))
    # Linked vectors share a component, so the links of each are counted within it, each pair once.
    members = materialise(hashed_rows.join(found, "id").select("component", "id", "copies", "unit"))

    def count(group: pa.Table) -> Iterator[dict]:
        linked, a, b, left = links(group)
        copies = group.column("copies").to_numpy()
        right = np.flatnonzero(group.column("right").to_numpy())
        yield {
            "id": np.concatenate([a, b]).tolist(),
            "n": np.concatenate([linked @ copies[right], linked.T @ copies[left]]).astype(np.int64).tolist(),
        }

    counted = each_task(block_pairs(members, ["component"]), ["id", "copies", "unit"], count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    whole = materialise(
        classed.join(found, "id", "left").join(counted, "id", "left")
        .select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    linked_rows = rows.where(sound).join(whole, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _alike(group: pa.Table, names: list[str]) -> Iterator[pa.Table]:
    """The group's rows with equal values of `names`; two groups can only meet by a clash of hashes."""
    keys = list(zip(*[group.column(n).to_pylist() for n in names], strict=True))
    if len(set(keys)) == 1:
        yield group
        return
    for k in sorted(set(keys), key=str):
        yield group.take([i for i, x in enumerate(keys) if x == k])
