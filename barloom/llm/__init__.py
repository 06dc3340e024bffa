"""Preparation of training text; nothing outside this subpackage imports it."""
