"""Windowed multi-channel signal analytics on Spark DataFrames."""
