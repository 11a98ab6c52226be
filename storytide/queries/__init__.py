"""The registered queries: each is a function of (spark, sf_dir), most with the same in SQL."""

from __future__ import annotations

from ..session import ship
from . import corpus, judging, narratives, operations, relations, reports, reviews, scans, statuses, themes
from .registry import QUERIES, SQL

__all__ = ["corpus", "flagship", "judging", "narratives", "operations", "oracle_sql", "queries", "relations", "reports", "reviews", "scans", "statuses", "themes"]


def flagship(spark, sf_dir: str):
    """The last day's theme-trend movers by dashboard score."""
    return QUERIES["dashboard_score_topk"](spark, sf_dir)


def _shipped(f):
    def run(spark, sf_dir: str):
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    return {k: _shipped(f) for k, f in QUERIES.items()}


def oracle_sql() -> dict:
    return dict(SQL)
