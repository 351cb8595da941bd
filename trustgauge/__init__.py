"""Extraction-reliability analytics and corpus operators on Spark DataFrames."""
