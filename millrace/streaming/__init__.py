"""Windowed and stateful forms of the aggregates for streams."""
