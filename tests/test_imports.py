"""Modules of queries, as a worker loads them: each alone and first, for a function that it holds."""

import os
import subprocess
import sys

import pytest
from conftest import ROOT


@pytest.mark.parametrize("name", ["base", "governance_queries", "quality_queries", "registry", "scalar_queries", "source_queries", "table_queries"])
def test_first_import(name):
    done = subprocess.run([sys.executable, "-c", f"import tessera.plans.{name}"], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
