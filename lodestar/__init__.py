"""Lodestar: evidence retrieval and corpus analytics on PySpark DataFrames."""
