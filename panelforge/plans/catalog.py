"""All queries of the engine and their SQL twins."""

from __future__ import annotations

from . import q_forecast, q_market, q_panel, q_reports, q_research, q_text  # noqa: F401  (they register)
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
