"""Imports every module that registers queries."""

from corpusloom.plans import code_queries, conversation_queries, corpus_queries, discovery_queries, evaluation_queries, governance_queries, numeric_queries, source_queries, text_queries, window_queries
from corpusloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "code_queries", "conversation_queries", "corpus_queries", "discovery_queries", "evaluation_queries", "governance_queries", "numeric_queries", "source_queries", "text_queries", "window_queries"]
