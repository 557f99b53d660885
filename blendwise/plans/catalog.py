"""All registered queries: importing this module fills the registry."""

from __future__ import annotations

from blendwise.plans import (  # noqa: F401
    loop_queries, loss_queries, metrics_queries, mixture_queries, packing_queries, qa_queries, source_queries,
    token_queries,
)
from blendwise.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
