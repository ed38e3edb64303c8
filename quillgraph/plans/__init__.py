"""Registered queries and the query surface."""
