"""Operators over DataFrames: search, sliding windows, batching, embedding."""
