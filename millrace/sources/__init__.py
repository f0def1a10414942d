"""Readers that turn files into DataFrames, and writers."""
