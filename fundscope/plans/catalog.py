"""Query catalog: one registered query per operator of SURVEY §2, each with its DuckDB oracle
(or none, for the rows-only check). Importing this module registers every query."""

from __future__ import annotations

from . import q_dashboard, q_merge, q_page_records, q_pages, q_records, q_storage, q_stream, q_text  # noqa: F401  (registration side effects)
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
