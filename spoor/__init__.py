"""Spoor: identify entities from their observed behaviour, on Spark DataFrames."""
