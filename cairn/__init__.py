"""Paired-comparison ratings, lineage queries and representation selection on Spark."""
