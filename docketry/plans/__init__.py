"""Registered queries: operators bound to tables, with their SQL twins."""

from docketry.plans import case_queries, field_queries, retrieval_queries, routing_queries, text_queries  # noqa: F401
from docketry.plans import stream_queries  # noqa: F401  (derives its SQL from the batch texts)
from docketry.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
