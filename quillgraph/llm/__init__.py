"""Operators for preparing language-model training data.

Each module holds one operator with its general interface; ``queries`` holds the thin registered queries.
Nothing outside this subpackage imports it.
"""
