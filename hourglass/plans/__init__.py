"""Queries that bind the operators to concrete tables, each with an equivalent SQL statement where SQL can say it."""
