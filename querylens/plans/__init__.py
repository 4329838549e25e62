"""Queries over the test tables, each with its SQL; importing them registers them."""

from . import cluster_queries, ir_queries, log_queries, source_queries  # noqa: F401
