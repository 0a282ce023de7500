"""All queries of the library and their DuckDB forms."""

from loomlens.plans import grading_queries, inspect_queries, score_queries

QUERIES = grading_queries.QUERIES | score_queries.QUERIES | inspect_queries.QUERIES
ORACLES = grading_queries.ORACLES | score_queries.ORACLES | inspect_queries.ORACLES
