"""Operators that prepare text collections for training. Nothing outside imports this package."""
