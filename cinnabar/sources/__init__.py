"""Readers and writers of reaction, molecule, rule, route and pattern files."""
