"""Operators that prepare posts as training data for language models."""
