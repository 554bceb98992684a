"""Relational operators: headers, filters, joins, aggregates, windows, rankings, quality checks."""
