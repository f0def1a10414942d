"""Training-data operators: ten components for preparing text corpora; nothing else in the library imports them."""
