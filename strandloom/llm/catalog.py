"""All queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from strandloom.llm import algorithm_queries, text_queries

MODULES = [algorithm_queries, text_queries]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
