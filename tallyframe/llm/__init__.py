"""Operators that prepare text corpora for model training; nothing else in the library imports this package."""
