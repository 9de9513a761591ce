"""The entry is imported before there is a session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 200)"], cwd=ROOT, capture_output=True, text=True)
    assert said.stdout.strip().endswith("True"), said.stderr
