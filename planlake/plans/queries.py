"""All registered queries of the plan operators."""

from planlake.plans import agg_queries, file_queries, graph_queries, join_queries, model_queries, pipeline_queries, scalar_queries, stream_queries  # noqa: F401
from planlake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
