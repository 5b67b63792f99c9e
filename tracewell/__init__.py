"""Trace analytics and sampling on Spark DataFrames."""
