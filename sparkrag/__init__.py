"""Retrieval, conversation and corpus analytics on PySpark DataFrames."""
