"""Composed plans, fixture views and the query registry."""
