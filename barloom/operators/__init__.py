"""Relational operators that Spark does not ship as such."""
