"""Tensor and linear-algebra analytics on PySpark DataFrames."""
