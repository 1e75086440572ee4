"""Whole queries on the given tables, each with equivalent SQL where SQL can express it."""
