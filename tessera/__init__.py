"""Relational synthetic data and its quality analytics on Spark DataFrames."""
