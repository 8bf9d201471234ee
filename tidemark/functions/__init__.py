"""Column functions: numbers, dates, text and rule lookups."""
