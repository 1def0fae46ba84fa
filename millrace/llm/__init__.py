"""Operators that prepare text and vectors for training; nothing outside this package imports it."""
