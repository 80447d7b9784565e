"""Dataflow steps: DataFrame in, DataFrame out."""
