"""Vectors stored by coarse cells, searched cell by cell with bounds from the cells' radii.

Centroids come from spherical k-means on a bounded sample; every vector is stored in the cell of its nearest centroid.
No vector of a cell is nearer to a query than its angle to the centroid less the cell's radius, so a cell whose bound
stays below a query's kth similarity is never read for it. Searched that way the result is exact; with a number of `probes`
only that many cells are read, and `recall` tells what this costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.operators.retrieval import _best_in_tile, _hit_schema, _unit, top_by
from passagework.session import materialise

#: Rows of one block of a cell, and queries scored on it at once.
BLOCK_ROWS = 20_000
#: Queries of a tile that read the same cells, and queries whose angles to all cells are held at once.
MET_QUERIES, BOUND_QUERIES = 2_048, 512
#: Similarities are compared after rounding to six places.
ROUNDING = 1e-5


@dataclass(frozen=True)
class Cells:
    centroids: np.ndarray  # unit rows, one a cell
    vectors: DataFrame  # cell, block, passage_id, work_slug, vector; in folders by cell
    sizes: DataFrame  # cell, blocks, n, radius (the greatest angle to the centroid)


def train_centroids(vectors: DataFrame, cells: int, *, sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Unit centroids of the `sample` vectors of least hash; equal seeds, so every run gives the same."""
    order = [F.xxhash64("passage_id"), "passage_id"]
    rows = vectors.orderBy(*order).select("vector").limit(sample).toPandas()["vector"]  # bounded by `sample`
    if rows.empty:
        return np.zeros((0, 0))
    rows = _unit(rows)
    centres = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return centres


def build_cells(vectors: DataFrame, cells: int | None = None, *, sample: int = 20_000, block_rows: int = BLOCK_ROWS) -> Cells:
    """Cells of `vectors` (passage_id, vector, and work_slug where there is one); rows without a vector are left out.

    Their number is the square root of the rows where it isn't given, 4,096 at most: a cell grows with the rest, and is
    dealt into blocks of about `block_rows`.
    """
    slug = F.col("work_slug") if "work_slug" in vectors.columns else F.lit("")
    given = vectors.filter("vector is not null").select("passage_id", slug.alias("work_slug"), "vector")
    n = given.count()
    centroids = train_centroids(given, cells or max(1, min(4_096, int(n**0.5))), sample=sample)
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cosines = _unit(b["vector"]) @ centroids.T
                best = cosines.argmax(1)
                yield b.assign(cell=best, angle=np.arccos(np.clip(cosines[np.arange(len(b)), best], -1, 1)))

    placed = given.mapInPandas(assign, f"passage_id {kinds['passage_id']}, work_slug string, vector {kinds['vector']}, cell int, angle double")
    blocks = max(1, -(-n // block_rows))  # a cell that holds everything still falls into blocks of that size
    stored = materialise(placed.withColumn("block", F.pmod(F.xxhash64("passage_id"), F.lit(blocks)).cast("int")), ("cell",))
    sizes = materialise(stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.array_sort(F.collect_set("block")).alias("blocks")))
    return Cells(centroids, stored, sizes)


def _filled(cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, radii and centroids of the cells that hold vectors."""
    known = {r.cell: r.radius for r in cells.sizes.select("cell", "radius").collect()}  # as many as cells
    names = np.array(sorted(known), dtype=int)
    radii = np.array([known[c] for c in names.tolist()])
    return names, radii, cells.centroids[names] if len(names) else cells.centroids


def cell_bounds(queries: DataFrame, cells: Cells, best: int | None = None) -> DataFrame:
    """(query_id, cell, bound, turn): the greatest cosine a vector of the cell can have to the query, best cells first.

    With `best`, only so many cells of each query.
    """
    names, radii, centroids = _filled(cells)
    kind = dict(queries.dtypes)["query_id"]

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = (b.iloc[i : i + BOUND_QUERIES] for b in batches for i in range(0, len(b), BOUND_QUERIES))
        for b in blocks:
            if not len(names):
                continue
            angles = np.arccos(np.clip(_unit(b["vector"]) @ centroids.T, -1, 1))
            bounds = np.cos(np.maximum(angles - radii, 0))
            turns = np.lexsort((np.broadcast_to(names, angles.shape), angles, -bounds))[:, :best]
            kept = [np.take_along_axis(x, turns, 1).ravel() for x in (bounds, angles)]
            yield pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), turns.shape[1]), "cell": names[turns.ravel()], "bound": kept[0], "angle": kept[1]})

    made = queries.select("query_id", "vector").mapInPandas(bound, f"query_id {kind}, cell int, bound double, angle double")
    return made.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "angle", "cell"))).drop("angle")


def cell_search(
    query_vectors: DataFrame, cells: Cells, *, query_works: DataFrame | None = None, limit: int = 100, probes: int | None = None, first: int = 2
) -> DataFrame:
    """Cosine top-k: query_id, passage_id, similarity, rank, as `retrieval.dense_search` gives it; exact without `probes`.

    The `first` cells of each query give its kth similarity. Then tiles of queries meet parts of the cells, each vector
    moving once a tile, and a block of queries near one another reads the cells whose bound reaches one of them only.
    """
    q = materialise(query_vectors.filter("vector is not null").select("query_id", "vector"))
    works = F.lit(None).cast("array<string>").alias("works")
    asked = q.select("*", works) if query_works is None else q.join(query_works.select("query_id", "works"), "query_id", "left")
    bounds = materialise(cell_bounds(q, cells, first if probes is None else probes))
    tiles = max(1, -(-q.count() // BLOCK_ROWS))

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.join(cells.sizes.select("cell", "blocks"), "cell").withColumn("block", F.explode("blocks"))
        left = met.join(asked, "query_id").select("query_id", "vector", "works", "cell", "block", F.pmod(F.xxhash64("query_id"), F.lit(tiles)).alias("tile"))
        right = (
            cells.vectors.join(pairs.select("cell").distinct(), "cell", "left_semi").select("passage_id", "work_slug", "vector", "cell", "block")
            .withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
        )
        tile = ["cell", "block", "tile"]
        return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(_best_in_tile(limit), _hit_schema(q, cells.vectors))

    found = scored(bounds.select("query_id", "cell"))
    if probes is None:
        last = top_by(found, ["query_id"], [F.desc("similarity"), "passage_id"], limit, "place").filter(F.col("place") == limit)
        least = materialise(last.select("query_id", (F.col("similarity") - ROUNDING).alias("least")))
        found = _scored_in_parts(asked.join(least, "query_id", "left"), cells, tiles, limit)
    return top_by(found.withColumn("similarity", F.round("similarity", 6)), ["query_id"], [F.desc("similarity"), "passage_id"], limit, "rank")


def _scored_in_parts(asked: DataFrame, cells: Cells, tiles: int, limit: int) -> DataFrame:
    """Best vectors of each query (query_id, vector, works, least) in each part of the cells, from the cells that its `least` leaves in reach."""
    cores = asked.sparkSession.sparkContext.defaultParallelism
    n = cells.vectors.count()
    parts = max(1, -(-n // BLOCK_ROWS), min(cores, -(-n // 2_000)))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    left = asked.withColumns({"tile": F.pmod(F.xxhash64("query_id"), F.lit(tiles)), "part": every(parts)})
    right = cells.vectors.select(
        "passage_id", "work_slug", "vector", "cell", every(tiles).alias("tile"), F.pmod(F.xxhash64("cell", "block"), F.lit(parts)).alias("part")
    )
    # Pairs of a tile and a part are few and small, but costly: they stay in tasks of their own.
    tasks, pair = min(2_000, 4 * tiles * parts), ["tile", "part"]
    left, right = left.repartition(tasks, *pair), right.repartition(tasks, *pair)
    near = _best_in_reach(limit, *_filled(cells))
    return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(near, _hit_schema(asked, cells.vectors))


def _best_in_reach(k: int, names: np.ndarray, radii: np.ndarray, centroids: np.ndarray):
    best = _best_in_tile(k)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [best(left.iloc[:0], right)]
        if len(left) and len(right):
            unit = _unit(left["vector"])
            nearest = [(unit[i : i + BOUND_QUERIES] @ centroids.T).argmax(1) for i in range(0, len(unit), BOUND_QUERIES)]
            order = np.argsort(np.concatenate(nearest), kind="stable")
            least = left["least"].fillna(-np.inf).to_numpy()
            for first in range(0, len(order), MET_QUERIES):
                rows = order[first : first + MET_QUERIES]
                reach = np.zeros(len(names), dtype=bool)
                for some in np.split(rows, range(BOUND_QUERIES, len(rows), BOUND_QUERIES)):
                    angles = np.arccos(np.clip(unit[some] @ centroids.T, -1, 1))
                    reach |= (np.cos(np.maximum(angles - radii, 0)) >= least[some][:, None]).any(0)
                out.append(best(left.iloc[rows], right[right["cell"].isin(names[reach])]))
        return pd.concat([x for x in out if len(x)]) if any(map(len, out)) else out[0]

    return run


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, recall: the share of a query's exact results that were found."""
    hits = exact.join(found.select("query_id", "passage_id", F.lit(1).alias("hit")), ["query_id", "passage_id"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
