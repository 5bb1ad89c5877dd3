"""Retrieval, indexing, chunking and graph operators over DataFrames."""
