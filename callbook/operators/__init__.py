"""Relational building blocks: sessions and as-of joins, exact quantiles,
ordering within keys, dense periods, keyed merges."""
