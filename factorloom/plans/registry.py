"""All registered queries: each takes (spark, sf_dir); ORACLES has the SQL that gives the same rows."""

from __future__ import annotations

from . import book_queries, desk_queries, health_queries, kernel_queries, label_queries, portfolio_queries, quality_queries, relational_queries, series_queries, service_queries, source_queries, weekly_queries  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "g05_daily_factor_returns"
