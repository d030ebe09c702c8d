"""Operators for large text corpora, and the queries that apply them to whole tables."""
