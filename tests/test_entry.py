"""The driver contract, with and without the optional subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__ as e

    queries, oracle = e.queries(), e.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 130


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_without_the_subpackage():
    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("hustings.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert len(names) > 120 and not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": str(ROOT)}, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.glob("hustings/**/*.py"):
        if "llm" not in path.parts:
            assert "hustings.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
