"""Every registered query: importing the plan modules fills the registry."""

from planloom.plans import (  # noqa: F401
    board_queries, document_queries, network_queries, page_queries, people_queries, provenance_queries, report_queries, schedule_queries,
    source_queries, stream_queries, validation_queries,
)
from planloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
