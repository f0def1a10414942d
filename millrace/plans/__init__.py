"""Analyses and layouts: requests bound to aggregate plans."""
