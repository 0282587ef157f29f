"""Operators for training-data pipelines over document, page and embedding tables.

Nothing outside this folder imports it. ``queries`` and ``oracle_sql`` have the named queries.
"""

from .queries import oracle_sql, queries  # noqa: F401
