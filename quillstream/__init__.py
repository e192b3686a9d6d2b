"""Spark-native engine for knowledge-base corpora: event log, notes, links, ranking, packs and record hygiene."""

__version__ = "0.1.0"
