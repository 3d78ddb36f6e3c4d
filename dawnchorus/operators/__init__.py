"""Relational operators: each a lazy ``DataFrame -> DataFrame`` function."""
