"""This subpackage's queries against SQL, and that the rest does without it."""

import subprocess
import sys
from pathlib import Path

import pytest

from strandloom.llm import catalog


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_same_as_sql(spark, small, same_as_sql, name):
    same_as_sql(spark, small, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL])
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_nothing_else_imports_this():
    root = Path(__file__).resolve().parents[2]
    hits = [p for p in (root / "strandloom").rglob("*.py") if "llm" not in p.relative_to(root).parts and "llm" in p.read_text()]
    assert hits == []
    code = "import sys; sys.modules['strandloom.llm'] = None\nimport __spark_entry__ as e\nassert e.queries() and not [n for n in e.queries() if n.startswith('p2')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
