"""Registered queries beside their oracle SQL on the smallest tables; ``tests/oracle.py`` runs them all."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

ROOT = "/root/testdata/sf0.001"
NAMES = sorted(set(entry.oracle_sql()) & {n for r in entry.all_registries() for n in r.oracles})
#: What other tests run beside something as good: PageRank's own query, and a fold in plain Python.
SLOW = {"repomap", "merkle_root"}


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SLOW])
def test_against_sql(spark, name):
    assert compare(spark, entry.queries()[name], entry.oracle_sql()[name], ROOT) is None


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 50
    assert "p4_found" in queries and "repomap" in oracles


def test_core_stands_without_the_subpackage():
    """With the training-data subpackage hidden, the rest imports and registers its queries."""
    code = "import sys; sys.modules['quillgraph.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p6_found' in q and 'p1_found' not in q; print(len(q))"
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
