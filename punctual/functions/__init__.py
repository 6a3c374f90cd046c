"""Column expressions: parsers of dirty readings, times, and formulas."""
