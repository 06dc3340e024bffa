"""Column functions: market-data arithmetic, ranking and text."""
