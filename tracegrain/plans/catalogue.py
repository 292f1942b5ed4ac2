"""Every registered query, by importing the modules that register them."""

from __future__ import annotations

from tracegrain.plans import queries_checks, queries_compare, queries_fleet, queries_documents, queries_events, queries_files, queries_findings, queries_records, queries_series, queries_stacks, queries_streaming  # noqa: F401
from tracegrain.plans.registry import ORACLES, QUERIES  # noqa: F401
