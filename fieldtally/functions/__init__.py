"""Column expressions: names, dates, values, geometry."""
