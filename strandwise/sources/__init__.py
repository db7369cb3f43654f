"""Readers: files in, DataFrames out, with every rejected record reported beside them."""
