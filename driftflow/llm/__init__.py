"""Operators for text corpora. Nothing outside this folder imports it."""
