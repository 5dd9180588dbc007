"""Operators for training data on code and the documents about it."""
