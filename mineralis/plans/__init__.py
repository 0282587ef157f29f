"""Named queries: each binds an operator to views over the given tables and, where SQL can say it,
carries the equivalent SQL."""

from __future__ import annotations

from .registry import all_queries, all_sql  # noqa: F401
