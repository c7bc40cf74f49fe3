"""Operators for preparing training data, over k-mer dumps, reads and document texts. Nothing outside this package imports it."""
