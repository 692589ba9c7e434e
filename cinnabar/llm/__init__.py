"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
contract queries and their SQL.
"""
