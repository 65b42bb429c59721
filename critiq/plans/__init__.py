"""Composed jobs over the given tables and their SQL counterparts."""
