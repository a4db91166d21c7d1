"""Sparvane: retrieval analytics and corpus preparation on PySpark DataFrames."""
