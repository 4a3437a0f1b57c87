"""Spectral anomaly analytics on Spark DataFrames, and operators for training data."""
