"""Registered queries against their SQL on the smallest tables.

One query per family by default; PASSAGEWORK_ALL=1 runs every one.
"""

import os
import pathlib

import pytest

import __spark_entry__ as entry
from passagework.plans.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "a3_validate_entries", "a5_sequence_index", "a12_rebuild_pages", "b1_matching_form", "b6_detect_language",
    "b8_flag_degenerate", "c1_chunk_documents", "d1_extract_references", "d7_classify_queries", "d9_merge_plans",
    "d11_structural_search", "d12_sparse_search", "d14_dense_search", "d17_hybrid_search", "e6_package_notes",
    "e12_answer_queries", "f6_align_passages", "f8_mine_quotations", "g7_reading_counts", "h5_verify_sentences",
    "i4_tradition_histogram", "j2_rule_checks", "k1_infer_pending", "l1_ranking_metrics",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("PASSAGEWORK_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
