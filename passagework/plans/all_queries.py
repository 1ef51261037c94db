"""Importing this module registers every query."""

from passagework.plans import (  # noqa: F401
    clause_queries,
    evidence_queries,
    maintenance_queries,
    report_queries,
    retrieval_queries,
    source_queries,
    text_queries,
)
