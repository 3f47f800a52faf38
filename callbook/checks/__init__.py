"""Registered queries: every operator over the given tables, next to the SQL
that computes the same answer independently."""
