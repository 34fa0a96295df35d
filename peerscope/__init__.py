"""Facility benchmarking operators for PySpark: DataFrame in, DataFrame out."""
