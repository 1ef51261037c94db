"""Batch inference over pending rows with any supplied function.

A function takes an iterator of pandas batches, so it loads its model once per
worker, and yields rows keyed by id, so results never depend on position.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.session import materialise

#: Words whose places a worker of the embedder remembers.
KNOWN_WORDS = 200_000

BatchFunction = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def infer_pending(
    passages: DataFrame,
    stored: DataFrame,
    fn: BatchFunction,
    *,
    target: str,
    translator: str,
    text: str = "raw_text",
    available: bool = True,
) -> DataFrame:
    """Outcome for every passage: passage_id, language, text, translator and status.

    status: `cached` (a stored one exists), `passthrough` (already in the target
    language), `fresh`, `empty` (nothing came back), `rejected` (degenerate, with
    a reason) or `unavailable`. Only pending rows reach the function.
    """
    done = stored.filter(F.col("language") == target).select("passage_id", F.lit(True).alias("_done")).distinct()
    tagged = passages.select("passage_id", "language", F.col(text).alias("_text")).join(done, "passage_id", "left")
    known = F.when(F.col("_done"), "cached").when(F.col("language") == target, "passthrough")

    def outcome(df: DataFrame, body: Column, status: Column, reason: Column) -> DataFrame:
        return df.select(
            "passage_id", F.lit(target).alias("language"), body.alias("text"), status.alias("status"), reason.alias("reason")
        )

    nothing = F.lit(None).cast("string")
    kept = outcome(
        tagged.filter(known.isNotNull()), F.when(known == "passthrough", F.col("_text")), known, nothing
    )
    # A passage of unknown language is pending like one of another language.
    foreign = tagged.filter(known.isNull()).select("passage_id", "language", F.col("_text").alias("text"))
    if available:
        kind = dict(foreign.dtypes)["passage_id"]
        # Written once: the function is called once per pending row, whatever reads its results.
        produced = materialise(foreign.mapInPandas(fn, f"passage_id {kind}, text string"))
        # A row the function did not return is empty, not lost.
        filled = foreign.select("passage_id").join(produced, "passage_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
        judged = T.flag_degenerate(filled, "text")
        status = F.when(T.is_blank("text"), "empty").when(F.col("degenerate"), "rejected").otherwise("fresh")
        fresh = outcome(
            judged, F.when(status == "fresh", F.col("text")), status, F.when(status != "empty", F.col("degenerate_reason"))
        )
        kept = kept.unionByName(fresh)
    else:
        kept = kept.unionByName(outcome(foreign, nothing, F.lit("unavailable"), nothing))
    return kept.withColumns(
        {
            "translator_kind": F.when(F.col("status") == "fresh", "MACHINE"),
            "translator_name": F.when(F.col("status") == "fresh", F.lit(translator)),
            "verification_status": F.when(F.col("status") == "fresh", "MACHINE_PROPOSED"),
        }
    )


def in_shards(
    rows: DataFrame, key: str, folder: str, job: Callable[[DataFrame], DataFrame], *, shards: int = 64
) -> DataFrame:
    """Run `job` on the rows shard by shard and read all results; a run that broke repeats only what it hadn't committed.

    Rows belong to shards by a hash of `key`, so every run deals them alike. A shard is committed when its own folder
    under `folder` is written whole (Spark's `_SUCCESS` file); the folders are the ledger. One folder serves one input
    and one job: give new rows a new one.
    """
    spark = rows.sparkSession
    paths = [f"{folder}/shards-{shards}/shard-{k:05d}" for k in range(shards)]
    for k, path in enumerate(paths):
        if not committed(spark, path):
            job(rows.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(shards)) == k)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(*paths)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a job has written `path` to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def storable(outcomes: DataFrame) -> DataFrame:
    """The rows to upsert by (passage_id, language, translator_name)."""
    return outcomes.filter(F.col("status") == "fresh").select(
        "passage_id", "language", "text", "translator_kind", "translator_name", "verification_status"
    )


def lookup_status(requested: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Status per requested passage id; ids without a passage are `not_found`."""
    return requested.select("passage_id").join(
        outcomes.select("passage_id", "status"), "passage_id", "left"
    ).withColumn("status", F.coalesce("status", F.lit("not_found")))


def embed_pending(passages: DataFrame, fn: BatchFunction, *, text: str = "raw_text") -> DataFrame:
    """passage_id, embedding for passages without one; rerun until none is left."""
    pending = passages.filter("embedding is null").select("passage_id", F.col(text).alias("text"))
    kind = dict(pending.dtypes)["passage_id"]
    return pending.mapInPandas(fn, f"passage_id {kind}, embedding array<float>")


# --------------------------------------------------------------------------
# Deterministic stand-ins for models
# --------------------------------------------------------------------------

def upper_case_translator(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Upper-cases text; returns nothing for German, as a model without it would."""
    for b in batches:
        yield pd.DataFrame(
            {"passage_id": b["passage_id"], "text": b["text"].str.upper().where(b["language"] != "de", "")}
        )


def hashing_embedder(dims: int) -> BatchFunction:
    """Unit vectors of word counts, words dealt to places by the first 32 bits of their md5."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @functools.lru_cache(maxsize=KNOWN_WORDS)
        def place(word: str) -> int:
            return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dims

        words = re.compile(r"[^ \t\n\x0b\x0c\r]+")
        for b in batches:
            vectors = np.zeros((len(b), dims), dtype=np.float32)
            for row, text in enumerate(b["text"]):
                for word, times in Counter(words.findall(text)).items():
                    vectors[row, place(word)] += times
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors /= np.where(norms == 0, 1, norms)
            yield pd.DataFrame({"passage_id": b["passage_id"], "embedding": list(vectors)})

    return run
