"""Operators for training-data pipelines: archives, filters, deduplication, mixing, packing and search.

Every operator takes and returns DataFrames, reads only the columns it names and keeps intermediate tables in the
folder that the cluster shares (``spark.checkpoint.dir``).
"""
