"""Registered queries: operators bound to the given tables."""

from examloom.plans import bank_queries, curation_queries, document_queries, page_queries, source_queries  # noqa: F401
from examloom.plans.registry import ORACLES, QUERIES  # noqa: F401
