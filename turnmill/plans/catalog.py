"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import metrics, training  # noqa: F401  register their queries
from .conversations import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
