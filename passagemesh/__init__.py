"""Passage-graph analytics on Spark: corpus text to similarity graph to graph retrieval."""

__version__ = "0.1.0"
