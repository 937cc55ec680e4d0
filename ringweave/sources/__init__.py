"""Readers of files into DataFrames, and writers back."""
