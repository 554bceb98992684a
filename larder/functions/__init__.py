"""Column expressions: text and number cleaning, stock arithmetic, calendar parts, message parsing."""
