"""The driver's entry module and the registry behind it."""

import ast
import pathlib
import subprocess
import sys
from collections import Counter

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("path", sorted(ROOT.glob("checks/*.py")), ids=lambda p: p.name)
def test_no_name_is_defined_twice(path):
    names = Counter(
        node.name for node in ast.parse(path.read_text()).body
        if isinstance(node, (ast.FunctionDef, ast.ClassDef)) and node.name != "_"
    )
    assert [name for name, n in names.items() if n > 1] == []


@pytest.mark.parametrize("lost", ["zstandard", "opslens.llm", "corpus_pipeline"])
def test_entry_survives_a_missing_library(lost):
    code = f"""
import sys
sys.modules[{lost!r}] = None  # import raises ModuleNotFoundError
import __spark_entry__ as entry
from checks.queries import QUERIES
assert set(entry.queries()) == set(QUERIES), "only the subpackage's queries may go"
assert set(entry.oracle_sql()) <= set(entry.queries())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
