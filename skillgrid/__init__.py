"""Forecast verification and gridded preparation on Spark: DataFrames in, DataFrames out."""
