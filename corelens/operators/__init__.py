"""Operators of the core-search engine."""
