"""Operators that prepare text and code for training language models. Nothing outside imports this package."""
