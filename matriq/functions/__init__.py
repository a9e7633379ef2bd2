"""Numerical pieces that work on small, already reduced input, in numpy."""
