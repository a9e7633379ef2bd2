"""Annotated matrices kept up to date from streams."""
