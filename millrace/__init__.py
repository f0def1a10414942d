"""Millrace: a PySpark-native engine that turns messy tabular files into profiled, aligned and analysed DataFrames."""

__version__ = "0.1.0"
