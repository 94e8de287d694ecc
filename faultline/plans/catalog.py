"""All registered queries."""

from . import (  # noqa: F401
    column_queries,
    event_queries,
    io_queries,
    knowledge_queries,
    line_queries,
    payload_queries,
    stage_queries,
    stream_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
