"""Operators for large text corpora (training-data preparation); nothing else in the library imports this folder."""
