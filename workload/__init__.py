"""Registered queries: inputs derived from the given tables, the Spark queries and their SQL checks."""
