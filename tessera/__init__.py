"""Corpus analytics on Spark: code and text units, near-duplicates, hierarchies and summaries."""

from tessera.plans.analysis import Report, analyze

__all__ = ["Report", "analyze"]
