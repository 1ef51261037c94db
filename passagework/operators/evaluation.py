"""Retrieval evaluation and relation paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking_metrics(judged: DataFrame, totals: DataFrame, *, k: int = 10) -> DataFrame:
    """Precision, recall, reciprocal rank and NDCG at k per query.

    judged: query_id, rank, relevance (graded, 0 = not relevant). totals:
    query_id, n_relevant; queries with nothing retrieved score 0. The ideal
    ordering is that of the judged grades filled up with relevant items of grade 1.
    """
    top = judged.filter(F.col("rank") <= k)
    gain = F.col("relevance") / F.log2(F.col("rank") + 1)
    per = top.groupBy("query_id").agg(
        F.count_if(F.col("relevance") > 0).alias("_hits"),
        F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("_first"),
        F.sum(gain).alias("_dcg"),
        F.filter(F.sort_array(F.collect_list("relevance"), asc=False), lambda r: r > 0).alias("_grades"),
    )
    missing = F.greatest(F.least(F.col("n_relevant"), F.lit(k)) - F.size("_grades"), F.lit(0)).cast("int")
    ideal = F.aggregate(
        F.transform(
            F.slice(F.concat("_grades", F.array_repeat(F.lit(1), missing)), 1, k),
            lambda r, i: r / F.log2(i + 2),
        ),
        F.lit(0.0), lambda a, x: a + x,
    )
    zero = F.lit(0.0)
    return (
        totals.join(per, "query_id", "left")
        .withColumn("_grades", F.coalesce("_grades", F.array().cast("array<int>")))
        .withColumn("_ideal", ideal)
        .select(
            "query_id",
            F.round(F.coalesce(F.col("_hits") / k, zero), 6).alias("precision_at_k"),
            F.round(F.when(F.col("n_relevant") > 0, F.coalesce(F.col("_hits") / F.col("n_relevant"), zero)).otherwise(zero), 6)
            .alias("recall_at_k"),
            F.round(F.coalesce(1 / F.col("_first"), zero), 6).alias("reciprocal_rank"),
            F.round(F.when(F.col("_ideal") > 0, F.coalesce(F.col("_dcg") / F.col("_ideal"), zero)).otherwise(zero), 6)
            .alias("ndcg_at_k"),
        )
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count("*").alias("queries"),
        *[
            F.round(F.avg(src), 6).alias(name)
            for src, name in (
                ("precision_at_k", "precision_at_k"), ("recall_at_k", "recall_at_k"),
                ("reciprocal_rank", "mrr"), ("ndcg_at_k", "ndcg_at_k"),
            )
        ],
    )


def breadth_by_place(query_places: DataFrame, placed: DataFrame) -> DataFrame:
    """Works represented and share of verified passages at each query's place.

    query_places: query_id, chapter, verse_start (one place per query). placed:
    passages with chapter, verse_start, work_slug, verification_status.
    """
    per = placed.groupBy("chapter", "verse_start").agg(
        F.count("*").alias("passages"), F.countDistinct("work_slug").alias("works_represented"),
        F.round(F.count_if(F.col("verification_status") == "VERIFIED") / F.count("*"), 6).alias("verified_share"),
    )
    return query_places.join(per, ["chapter", "verse_start"]).select(
        "query_id", "passages", "works_represented", "verified_share"
    )


def works_represented(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(F.countDistinct("work_slug").alias("works_represented"))


def claim_rates(claims: DataFrame) -> DataFrame:
    """Per query: claims, evidence coverage and unsupported-claim rate.

    claims: query_id, supported (boolean).
    """
    return claims.groupBy("query_id").agg(
        F.count("*").alias("claims"),
        F.round(F.count_if("supported") / F.count("*"), 6).alias("evidence_coverage"),
        F.round(F.count_if(~F.col("supported")) / F.count("*"), 6).alias("unsupported_rate"),
    )


def citation_accuracy(citations: DataFrame) -> DataFrame:
    """Per query: share of citations whose passage supports the claim.

    citations: query_id, passage_id, supported.
    """
    return citations.groupBy("query_id").agg(
        F.count("*").alias("citations"),
        F.round(F.count_if("supported") / F.count("*"), 6).alias("citation_accuracy"),
    )


def two_hops(first: DataFrame, second: DataFrame) -> DataFrame:
    """Paths of two relations: start, via, finish and both relation names.

    Edges are (from_id, to_id, relation).
    """
    a = first.select(F.col("from_id").alias("start"), F.col("to_id").alias("via"), F.col("relation").alias("relation_1"))
    b = second.select(F.col("from_id").alias("via"), F.col("to_id").alias("finish"), F.col("relation").alias("relation_2"))
    return a.join(b, "via")
