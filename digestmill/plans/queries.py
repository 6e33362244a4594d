"""All registered queries."""

from __future__ import annotations

from digestmill.plans import (  # noqa: F401
    digest_queries, flow_queries, ledger_queries, library_queries, page_queries, quality_queries, transcript_queries, url_queries,
)
from digestmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
