"""Language identification by the nearest of several centroids per language.

Texts become normalised TF-IDF vectors of hashed character n-grams. Each language has a few centroids, found by
spherical k-means. A text takes the language of the centroid with the greatest cosine, and is rejected if even
that one is farther away than documents of its language are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.common import chunks, mapped
from passagework.operators.tables import bounded

#: Hashed n-gram dimensions.
DIMENSIONS = 4096
#: Rows expanded to dense vectors at once.
ROWS = 256
UNKNOWN = "und"
#: ASCII that is no letter separates words.
SEPARATED = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; figures such as superscripts, fractions and numerals are none."""
    return any(map(str.isalpha, text or ""))


def grams(text: str) -> np.ndarray:
    """Hashed codes of the text's n-grams of two and three bytes."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(SEPARATED) + b" ", dtype=np.uint8).astype(np.uint32)
    pairs = raw[:-1] * np.uint32(257) + raw[1:]
    triples = pairs[:-1] * np.uint32(257) + raw[2:]
    codes = np.concatenate([pairs, triples]) * np.uint32(2654435761)
    return codes >> np.uint32(32 - 12)


def vectors(texts: list[str]) -> np.ndarray:
    """Dampened n-gram counts of each text."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for i, text in enumerate(texts):
        out[i] = np.bincount(grams(text), minlength=DIMENSIONS)
    return np.log1p(out)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    languages: list[str]  # of each centroid
    nearest: np.ndarray  # least cosine that each centroid accepts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine to its nearest centroid, and whether it is rejected."""
        known = np.array([bool(self.languages) and has_letter(t) for t in texts], dtype=bool)
        names, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        at = np.flatnonzero(known)
        for s in range(0, len(at), ROWS):
            rows = at[s : s + ROWS]
            cosines = unit(vectors([texts[i] for i in rows]) * self.idf) @ self.centroids.T
            best = cosines.argmax(1)
            for i, c, value in zip(rows.tolist(), best.tolist(), cosines.max(1).tolist(), strict=True):
                names[i], scores[i], rejected[i] = self.languages[c], min(max(value, 0.0), 1.0), value < self.nearest[c]
        return names, scores, rejected


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows by spherical k-means, seeded by farthest points."""
    seeds = [0]
    for _ in range(1, min(k, len(rows))):
        seeds.append(int((rows @ rows[seeds].T).max(1).argmin()))
    centres = rows[seeds]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        filled = np.bincount(own, minlength=len(centres)) > 0
        centres = unit(np.where(filled[:, None], sums, centres))
    return centres


#: Tasks among which the rows of one language are dealt when its sample is chosen.
SALTS = 32


def fit(labelled: DataFrame, *, per_language: int = 200, sample_rows: int = 6_400, clusters: int = 4, slack: float = 0.3) -> Model:
    """Fit from the text and lang of `labelled`; rows without either are left out. Every language is learned.

    Document frequencies count all rows. Centroids are fitted on a bounded sample, the rows of least hash of each
    language: `per_language` of each, or, with many languages, as many as make up `sample_rows` in all (`clusters` of
    each at least). A centroid accepts cosines down to `slack` times
    the least that a sampled row of its language has to its own nearest centroid.
    """
    rows = labelled.select("lang", "text").where("lang is not null and text is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(DIMENSIONS + 1, dtype=np.int64), 0
        for b in chunks(batches):
            for t in b.column("text").to_pylist():
                held[:-1] += np.bincount(grams(t), minlength=DIMENSIONS) > 0
                n += 1
        held[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(held)], ["gram", "held"])

    counts = np.zeros(DIMENSIONS + 1)
    for r in rows.select("text").transform(mapped, frequencies, "gram long, held long").groupBy("gram").agg(F.sum("held").alias("held")).collect():
        counts[r.gram] = r.held
    idf = (np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1).astype(np.float32)

    # The sample is chosen on hashes alone; only its own texts travel. A language that most rows have is first cut in parts.
    hashed = rows.withColumn("h", F.xxhash64("text"))
    languages = rows.select("lang").distinct().count()
    each = max(clusters, min(per_language, sample_rows // max(1, languages)))
    part = Window.partitionBy("lang", "salt").orderBy("h")
    least = (
        hashed.select("lang", "h", F.pmod("h", F.lit(SALTS)).alias("salt")).distinct()
        .withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= each)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= each)
    )
    # One row a language, read as a local table where it is one, so that the join moves no text.
    cut = bounded(least.groupBy("lang").agg(F.max("h").alias("cut")))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            for s in range(0, b.num_rows, ROWS):
                part = b.slice(s, ROWS)
                made = [v.tobytes() for v in vectors(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array(made, pa.binary())], ["lang", "h", "v"])

    picked = hashed.join(cut, "lang").where("h <= cut").dropDuplicates(["lang", "h"]).select("lang", "h", "text")
    held: dict[str, list[tuple[int, bytes]]] = {}
    for r in picked.transform(mapped, sample, "lang string, h long, v binary").collect():  # bounded by the sample
        held.setdefault(r.lang, []).append((r.h, bytes(r.v)))
    centroids, named, nearest = [], [], []
    for lang in sorted(held):
        own = unit(np.frombuffer(b"".join(v for _, v in sorted(held[lang])), dtype=np.float32).reshape(-1, DIMENSIONS) * idf)
        centres = cluster(own, clusters)
        least = float((own @ centres.T).max(1).min()) * slack
        centroids.append(centres)
        named += [lang] * len(centres)
        nearest += [least] * len(centres)
    return Model(idf, np.concatenate(centroids) if centroids else np.zeros((0, DIMENSIONS), np.float32), named, np.array(nearest))


def held_out(folds: int = 5):
    """Whether crc32 of the doc_id as text, modulo `folds`, is 0; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row.

    A null text, or one without a letter, is `und` with score 0 and rejected. Very long texts count whole; repeated
    rows repeat; an empty table gives no rows; no other column is read.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            names, scores, rejected = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(names), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", "text").transform(mapped, predict, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that `model` does not reject, with all their columns.

    Rows whose text is null, empty or without a letter go; repeated rows are judged alike and all stay or go; very long texts
    are judged whole; an empty table stays empty; further columns travel along unread, whatever their names.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            rejected = model.predict(b.column("text").to_pylist())[2]
            yield b.filter(pa.array([not x for x in rejected], pa.bool_()))

    return docs.transform(mapped, keep, docs.schema)
