"""Registered queries and the SQL that they are checked against."""

from __future__ import annotations

from matriq.plans import base, files, matrix, spatial, statistics, tables  # noqa: F401  (they register their queries)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
