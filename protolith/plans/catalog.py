"""All queries over the driver's tables and their SQL, by name."""

from __future__ import annotations

from protolith.plans import corpus_queries, evaluation_queries, report_queries, vector_queries
from protolith.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "corpus_queries", "evaluation_queries", "report_queries", "vector_queries"]
