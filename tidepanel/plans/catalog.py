"""All registered queries."""

from __future__ import annotations

from tidepanel.plans import queries_features, queries_reports, queries_state  # noqa: F401  (register on import)
from tidepanel.plans.registry import QUERIES, Query, present_sql
from tidepanel.plans.shared_sql import steady_rounds, with_tables


def oracle(q: Query) -> str:
    return with_tables(present_sql(q.spec, steady_rounds(q.sql)))


__all__ = ["QUERIES", "oracle"]
