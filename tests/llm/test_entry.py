"""The driver reads the queries before it has a session."""

import subprocess
import sys
from pathlib import Path


def test_queries_are_read_without_a_session():
    code = 'import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len([n for n in q if n.startswith("op") and n[2:3].isdigit()]) == 10 and "pipeline" in q and set(o) <= set(q)'
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], check=True, timeout=120)
