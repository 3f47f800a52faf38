"""Column expressions: text, stance, dates, statistics."""
