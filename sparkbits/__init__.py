"""Bit vectors as a column type on PySpark DataFrames."""
