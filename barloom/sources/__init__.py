"""Readers and writers."""

from barloom.sources.tables import table

__all__ = ["table"]
