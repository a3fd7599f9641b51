"""Batch data exploration on PySpark: every analysis is a function from DataFrames to DataFrames."""
