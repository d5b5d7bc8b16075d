"""All core queries by name, and their SQL."""

from __future__ import annotations

from strandloom.plans import alignment_queries, assembly_queries, contact_queries, core_problems, coverage_queries, dual_queries, sequence_queries, source_queries

MODULES = [core_problems, sequence_queries, alignment_queries, contact_queries, coverage_queries, assembly_queries, dual_queries, source_queries]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
