"""Operators for preparing training text and vectors, with their queries in ``catalog``."""
