"""All registered queries of the conversation operators."""

from turnwise.plans import aggregate_queries, corpus_queries, data_queries, extension_queries, relational_queries, scoring_queries  # noqa: F401
from turnwise.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
