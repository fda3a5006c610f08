"""Incremental forms of the sample aggregations."""
