"""Palisade: finding, scoring, profiling and masking personal data with Spark DataFrames."""
