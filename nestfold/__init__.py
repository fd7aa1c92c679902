"""Listing matching on Spark: normalise, filter, enrich, match, rank and fold feedback."""

__version__ = "0.1.0"
