"""Composite plans, stand-in views over the given tables and the query catalogue."""
