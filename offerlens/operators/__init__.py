"""Relational operators: joins, latest rows, aggregation, ranking, deduplication, scoring."""
