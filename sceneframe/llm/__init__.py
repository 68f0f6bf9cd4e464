"""Operators for large text corpora: one module per operator, their queries and oracle SQL in ``queries``."""
