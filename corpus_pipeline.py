"""A training corpus in five stages, each of which reads what the one before it wrote.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of `docs`, further
columns of any name included. Repeated rows and very long texts are documents like others; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from passagework.llm.common import table
from passagework.llm.decontamination import drop_contaminated
from passagework.llm.jaccard import keep_one_of_each
from passagework.llm.language import fit as fit_languages
from passagework.llm.language import held_out, keep_identified
from passagework.llm.personal_data import fit as fit_personal_data
from passagework.llm.personal_data import mask_documents
from passagework.llm.pieces import encode_pieces, piece_digests
from passagework.session import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known go on.

    Those without text or without a letter are rejected; of an empty table nothing is learned and nothing goes on.
    """
    return keep_identified(docs, fit_languages(docs.where(~held_out())))


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies goes on: that of the smallest doc_id, one row of it where it repeats.

    Documents without words, and those without a doc_id, are near to none and go on.
    """
    return keep_one_of_each(docs, length=5, threshold=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage go on; without text, or without items, all do."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents go on, with personal data masked; those without text as they are."""
    return mask_documents(docs, fit_personal_data(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text; a null text counts as empty."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_digests(encode_pieces(docs, model, decode=True))


STAGES = [
    ("language", identify_language),
    ("near_copies", join_similar),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("pieces", encode),
]

#: A trained field and centroids have no SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
