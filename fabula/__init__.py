"""Narration-script analytics on Spark DataFrames."""
