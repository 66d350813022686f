"""Curation, scoring and evaluation of instruction data on Spark."""
