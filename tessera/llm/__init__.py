"""Operators that prepare large-scale training data."""
