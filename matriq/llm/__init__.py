"""Operators for cleaning training text. Nothing outside this package imports it."""
