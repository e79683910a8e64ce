"""Named queries over the driver tables, with their SQL."""

from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

from . import curation_queries, loop_queries, message_queries, model_queries, routing_queries, run_queries, skill_queries, stream_queries, trace_queries  # noqa: E402, F401
