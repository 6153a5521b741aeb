"""Operators that prepare text and record collections for training. Nothing outside imports this package."""
